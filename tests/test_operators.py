"""Operators over cues, segments, replies, trials, clips, files and the ledger."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.functions import timing
from cueloom.operators import batches, cues, fit, ledger, quality, segments, timeline
from cueloom.schemas import CUES, REPLIES
from cueloom.sinks import documents, stores
from cueloom.sources import captions, tables


def cue_table(spark, *rows, video=1):
    return spark.createDataFrame([(video, n, float(s), float(e), t) for n, (s, e, t) in enumerate(rows)], CUES)


def times(df, *more):
    return [tuple(r) for r in df.select("start_s", "end_s", *more).orderBy("start_s").collect()]


def test_runs_break_above_the_gap_and_end_with_the_last_cue(spark):
    table = cue_table(spark, (0, 1, "a"), (1.75, 3, "b"), (2, 2.5, "c"), (3.2501, 4, "d"), (5, 6, None))
    assert times(cues.pause_runs(table), "n_cues", "text") == [(0.0, 2.5, 3, "a b c"), (3.2501, 4.0, 1, "d"), (5.0, 6.0, 1, "")]


def test_rolling_captions_collapse_to_the_longest(spark):
    table = cue_table(spark, (0, 1, "we are"), (1, 2, "We are here"), (2, 3, "we are here"), (3.5, 4, "new"), (9, 10, "end"))
    assert times(cues.collapse_rolling(table), "text") == [(0.0, 3.5, "we are here"), (3.5, 9.0, "new"), (9.0, 10.0, "end")]
    assert times(cues.collapse_rolling(table, extend_to_next=False), "text")[0] == (0.0, 3.0, "we are here")


def test_suffixes_only(spark):
    table = cue_table(spark, (0, 1, "a b"), (1, 2, "a b, c"), (2, 3, "a b, c"), (3, 4, "x"), (4, 5, ""))
    assert times(cues.suffix_delta(table), "text") == [(0.0, 1.0, "a b"), (1.0, 2.0, "c"), (3.0, 4.0, "x"), (4.0, 5.0, "")]


def test_windows(spark):
    table = cue_table(spark, (0, 2, "a"), (4, 6, "b"), (7, 8, "c"))
    assert times(cues.clip_window(table, 5, 1)) == [(1.0, 2.0), (4.0, 5.0)] and times(cues.overlap_filter(table, 5, 1)) == [(0.0, 2.0), (4.0, 6.0)]


def test_times_are_shared_by_characters(spark):
    units = spark.createDataFrame([(1, 0, 0, 0.0, 9.0, "aa"), (1, 0, 1, 0.0, 9.0, "bbbb"), (1, 0, 2, 0.0, 9.0, "ccc"), (1, 1, 0, 20.0, 20.02, "a"), (1, 1, 1, 20.0, 20.02, "b")], "video_id long, run_id long, unit_no long, start_s double, end_s double, text string")
    got = times(segments.allocate_times(units), "text")
    assert got[:3] == [(0.0, 2.0, "aa"), (2.0, 6.0, "bbbb"), (6.0, 9.0, "ccc")] and got[-1][1] == 20.02


def test_segments_keep_words_order_and_pauses(spark):
    text = "First we went to the market. Then, because it was late and the shops had closed, we walked all the way back home and talked about it. Fine."
    words = text.split()
    table = cue_table(spark, *[(i * 0.9 + (3 if i > 12 else 0), (i + 1) * 0.9 + (3 if i > 12 else 0), " ".join(words[i * 2 : i * 2 + 2])) for i in range(len(words) // 2)])
    got = segments.segment_cues(table).orderBy("idx").collect()
    assert " ".join(r["en"] for r in got).split() == words[: len(words) // 2 * 2] and [r["idx"] for r in got] == list(range(len(got)))
    assert all(a["end_s"] <= b["start_s"] + 1e-9 for a, b in zip(got, got[1:], strict=False)) and all(r["end_s"] > r["start_s"] for r in got)
    assert not any(r["start_s"] < 11.7 < 14.0 < r["end_s"] for r in got)


def test_fragments_are_glued_alike_by_fold_and_windows(spark):
    rows = [(0, 2, "Well, I think they're"), (2, 4, "going home."), (4, 6, "That was a good long day"), (6, 7, "lucky."), (7, 9, "the end of it")]
    units = spark.createDataFrame([(1, 0, n, float(s), float(e), t) for n, (s, e, t) in enumerate(rows)], "video_id long, run_id long, unit_no long, start_s double, end_s double, text string")
    glued = [r["text"] for r in segments.glue_fragments(units).orderBy("sentence_no").collect()]
    assert glued == ["Well, I think they're going home.", "That was a good long day lucky.", "the end of it"]
    packed = segments.pack_segments(units, target_len=0.0, min_seg_dur=0.0, min_seg_words=0)
    assert [r["en"] for r in packed.orderBy("idx").collect()] == glued


def test_slots(spark):
    table = cue_table(spark, (0, 1, "a"), (1.2, 2, "b"), (9, 9.01, "c")).withColumnRenamed("cue_no", "idx")
    assert [round(r["slot_s"], 6) for r in segments.slot_with_lead(table).orderBy("idx").collect()] == [1.2, 1.15, 0.05]


def lines(spark, n, video=1):
    return spark.createDataFrame([(video, i, f"line {i}") for i in range(n)], "video_id long, idx long, en string")


def counted(folder, fn):
    """fn, with a file left for each call, as tasks run in other processes; and the number of lines asked for so far."""
    folder.mkdir()

    def call(payload):
        (folder / uuid.uuid4().hex).write_text(payload)
        return fn(payload)

    return call, lambda: sorted(len(f.read_text().split("\n")) for f in folder.iterdir())


def forgetful():
    """A function that leaves out line 7 of long payloads; made here, so that tasks get it by value."""

    def call(payload):
        out = payload.split("\n")
        return "\n".join(f"{x.split('. ')[0]}. 译{x.split('. ')[1]}" for x in out if not x.startswith("7.") or len(out) < 10)

    return call


def test_transform_is_refilled(spark, tmp_path):
    fn, asked = counted(tmp_path / "calls", forgetful())
    table = lines(spark, 130)
    real = batches.translate(table, fn)
    assert real.count() == 128 and {r["idx"] for r in batches.missing_lines(table, real).collect()} == {6, 106} and asked() == [30, 100]
    final, rounds = batches.refill_rounds(table, real, fn)
    assert final.count() == 130 and [tuple(r) for r in rounds.collect()] == [(1, 2, 2)] and asked() == [2, 30, 100]
    again, none = batches.refill_rounds(table, final, fn)
    assert again.count() == 130 and none.count() == 0 and asked() == [2, 30, 100]


def test_transform_is_resumed_from_its_store(spark, tmp_path):
    fn, asked = counted(tmp_path / "calls", forgetful())
    table, store = lines(spark, 130), f"file://{tmp_path}/store"
    real = batches.translate(table, fn, store=store)
    assert real.count() == 128 and asked() == [30, 100]
    assert batches.translate(table, fn, store=store).count() == 128 and asked() == [30, 100]  # killed before the refill: nothing is asked again
    final, _ = batches.refill_rounds(table, real, fn, store=store)
    assert final.count() == 130 and asked() == [2, 30, 100]
    again = batches.translate(table, fn, store=store)
    assert {(r["idx"], r["zh"]) for r in again.collect()} == {(i, f"译line {i}") for i in range(130)} and asked() == [2, 30, 100]
    assert batches.refill_rounds(table, again, fn, store=store)[1].count() == 0 and asked() == [2, 30, 100]
    longer = table.unionByName(lines(spark, 5, video=2))
    assert batches.translate(longer, fn, store=store, waves=3).count() == 135 and asked() == [2, 5, 30, 100]


def test_killed_wave_loses_no_other(spark, tmp_path):
    fn, asked = counted(tmp_path / "calls", forgetful())
    table, store = lines(spark, 300), f"file://{tmp_path}/store"
    whole = batches.append_lines
    stored = []

    def killed(*args, **options):
        if stored:
            raise KeyboardInterrupt
        whole(*args, **options)
        stored.append(1)

    with pytest.MonkeyPatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(batches, "append_lines", killed)
        batches.translate(table, fn, store=store, waves=8)
    before = len(asked())
    assert batches.translate(table, fn, store=store, waves=8).count() == 297 and len(asked()) == before + 2


def test_failed_batches_are_split(spark, tmp_path):
    answer = forgetful()

    def narrow(payload):
        if len(payload.split("\n")) > 40:
            raise ValueError("too long")
        return answer(payload)

    fn, asked = counted(tmp_path / "calls", narrow)
    real = batches.translate(lines(spark, 130), fn)
    assert {r["idx"] for r in real.collect()} == set(range(130)) - {6, 46, 86, 106} and asked() == [20, 30, 40, 40, *[100] * 5]


def test_stored_echoes_are_asked_again(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    table = lines(spark, 3)
    batches.append_lines(table.withColumnRenamed("en", "zh"), store, refill=False)
    fn, asked = counted(tmp_path / "calls", forgetful())
    assert batches.translate(table, fn, store=store).count() == 3 and asked() == [3]


def test_failures_become_rows(spark):
    def fn(payload):
        raise ValueError("no service")

    out = batches.apply_batches(batches.build_requests(batches.assign_batches(lines(spark, 3))), fn, attempts=2).collect()
    assert [(r["body"], r["error"], r["expected"]) for r in out] == [(None, "no service", 3)]


def test_one_line_batch_without_reply_counts_as_done(spark):
    replies = spark.createDataFrame([(1, 0, 1, ""), (2, 0, 2, "1. 译")], "video_id long, batch_no long, expected long, body string")
    got = tables.read_batches(replies, lines(spark, 1).union(lines(spark, 2, 2))).orderBy("video_id").collect()
    assert [(r["ok"], r["done"]) for r in got] == [(0, True), (1, True)]
    assert batches.missing_lines(lines(spark, 1), spark.createDataFrame([], "video_id long, idx long")).count() == 1


def test_fallback(spark):
    table = spark.createDataFrame([(1, 0, "Ok um go", "go"), (1, 1, "x", " 译 "), (1, 2, "um hi", "")], "video_id long, idx long, en string, zh string")
    assert [(r["zh"], r["is_fallback"]) for r in batches.fallback_fill(table).orderBy("idx").collect()] == [("go", True), ("译", False), ("hi", True)]


@pytest.mark.parametrize(("trials", "want"), [
    ([(0, 0, 5.0, 0)], (0, 0, 5.0, "ok")),
    ([(0, 0, 7.0, 0), (0, 1, 5.5, 0)], (0, 30, 5.5, "ok")),
    ([(0, 0, 9.0, 0), (0, 1, 7.0, 0), (1, 0, 5.05, 0)], (1, 0, 5.05, "compressed")),
    ([(0, 0, 9.0, 0), (0, 1, 7.0, 0), (1, 0, 8.0, 0), (1, 1, 7.5, 0)], (1, 30, 7.5, "overflow")),
    ([(0, 0, 9.0, 0), (0, 1, 7.0, 0), (1, 0, 8.0, 1)], (0, 30, 7.0, "overflow")),
    ([(0, 0, 5.5, 0), (0, 1, 5.0, 1)], (0, 0, 5.5, "tts_rate_fail")),
    ([(0, 0, 9.0, 0), (0, 1, 5.0, 1), (1, 0, 4.0, 0)], (0, 0, 9.0, "overflow")),
    ([(0, 0, 5.0, 1), (1, 0, 5.0, 1)], (None, None, None, "no_audio")),
])
def test_chosen_trials(spark, trials, want):
    table = spark.createDataFrame([(1, 0, *t) for t in trials], "video_id long, idx long, cand_no int, fast int, dur double, failed int")
    slots = spark.createDataFrame([(1, 0, 5.0)], "video_id long, idx long, slot_s double")
    row = fit.choose_trial(table, slots).first()
    assert (row["cand_no"], row["rate_pct"], row["dur"], row["note"]) == want


def test_inner_clip_wins_and_outer_resumes(spark):
    clips = spark.createDataFrame([(1, 0, 0.0, 30.0), (1, 1, 5.0, 6.0), (1, 2, 40.0, 50.0), (1, 3, 60.0, 61.0)], "video_id long, seq long, start_s double, end_s double")
    totals = spark.createDataFrame([(1, 45.0), (2, 1.0)], "video_id long, total_s double")
    got = [(r["video_id"], r["from_sample"] / 24000, r["to_sample"] / 24000, r["seq"]) for r in timeline.timeline_overlay(clips, totals).orderBy("video_id", "from_sample").collect()]
    assert got == [(1, 0, 5, 0), (1, 5, 6, 1), (1, 6, 30, 0), (1, 30, 40, None), (1, 40, 45, 2), (2, 0, 1, None)]


def test_report_without_lines_does_not_pass(spark):
    rows = spark.createDataFrame([(1, 0, "", "", "ok"), (2, 0, "译", "", "overflow"), (2, 1, "译", "old.mp3", "ok"), (3, 0, "译", "", "ok")], "video_id long, idx long, zh string, audio string, note string")
    files = spark.createDataFrame([(2, "seg_0000.mp3", 499, 1.0), (2, "seg_0000_r10.mp3", 500, 1.0), (2, "old.mp3", 800, 1.0), (3, "seg_0000.mp3", 10, 1.0)], "video_id long, name string, size_bytes long, dur double")
    got = {r["video_id"]: r for r in quality.validation_report(rows, files).collect()}
    assert not got[1]["pass"] and got[2]["pass"] and got[2]["audio_ok"] == 2 and got[2]["overflow"] == 1 and got[3]["audio_missing"] == [0]
    assert {(r["idx"], r["name"]) for r in quality.match_audio(rows, files).collect()} == {(0, "seg_0000_r10.mp3"), (1, "old.mp3")}


def test_ledger(spark):
    rows = [(1, o, o, "done") for o in range(8)] + [(2, 0, 1, "done"), (2, 1, 2, "running"), (2, 1, 3, "failed")]
    log = spark.createDataFrame(rows, "video_id long, ord int, seq long, status string")
    assert dict(map(tuple, ledger.job_status(log).collect())) == {1: "done", 2: "failed"}
    assert dict(map(tuple, ledger.next_pending(log).collect())) == {1: None, 2: "prepare_video"}
    again = ledger.reset_from(log, log.where("video_id = 1"), "tts", 99)
    assert dict(map(tuple, ledger.next_pending(again).collect()))[1] == "tts" and dict(map(tuple, ledger.job_status(again).collect()))[1] == "pending"


def test_job_report(spark):
    rows = [(1, o, o, "done", f"t{o}", None, None) for o in range(8)] + [(2, 0, 1, "done", "a", None, None), (2, 1, 2, "failed", "b", "broken", True), (3, 0, 1, "failed", "c", "gone", False), (3, 0, 2, "running", "d", None, None)]
    log = spark.createDataFrame(rows, "video_id long, ord int, seq long, status string, at string, error string, retryable boolean")
    got = {}
    for r in ledger.job_report(log).orderBy("video_id", "line_no").collect():
        got.setdefault(r["video_id"], []).append(r["line"])
    assert got == {
        1: ["status   done", "stage    compose", "updated  t7"],
        2: ["status   failed", "stage    prepare_video", "updated  b", "error    broken", "retryable yes", "resume   prepare_video"],
        3: ["status   running", "stage    download", "updated  d", "resume   download"],
    }


def test_found_audio_is_written_back(spark):
    rows = spark.createDataFrame([(1, 0, "译", "", "x"), (1, 1, "译", "old/here.mp3", "x"), (1, 2, "译", "gone.mp3", "x")], "video_id long, idx int, zh string, audio string, note string")
    files = spark.createDataFrame([(1, "seg_0000.mp3", 600, 1.0), (1, "here.mp3", 700, 1.0), (1, "seg_0001_r10.mp3", 900, 1.0)], "video_id long, name string, size_bytes long, dur double")
    out = quality.attach_audio(rows, files)
    assert out.columns == rows.columns and {r["idx"]: r["audio"] for r in out.collect()} == {0: "audio/seg_0000.mp3", 1: "audio/here.mp3", 2: "gone.mp3"}


def test_documents_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0.0, 1.5, "one", "一"), (1, 1, 2.0, 3.25, "two", ""), (1, 2, 4.0, 5.0, "three", "三\n四{x}")], "video_id long, idx long, start_s double, end_s double, en string, zh string")
    srt = documents.render_srt(rows).first()["body"]
    assert srt == "1\n00:00:00,000 --> 00:00:01,500\n一\n\n2\n00:00:04,000 --> 00:00:05,000\n三\n四{x}\n"
    parsed = captions.parse_srt(spark.createDataFrame([(1, srt)], "video_id long, value string"))
    assert times(parsed, "text") == [(0.0, 1.5, "一"), (4.0, 5.0, "三 四{x}")]
    assert documents.render_ass(rows).first()["body"].endswith("Dialogue: 0,0:00:00.00,0:00:01.50,ZH,,0,0,0,,一\nDialogue: 0,0:00:04.00,0:00:05.00,ZH,,0,0,0,,三 四(x)\n")
    documents.write_documents(documents.render_srt(rows), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("video_id", "body", "bucket").collect()] == [(1, srt, 1)]


def test_caption_files(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "a.vtt").write_bytes("WEBVTT\r\n\r\n00:01.000 --> 00:02.000\r\nshort time\r\n\r\n00:00:01.000 --> 00:00:02.000 align:start\r\nfirst\r\nNOTE x\r\n<c>last &amp; best</c>\r\n\r\n00:00:03.000 --> 00:00:03.010\r\nbrief\r\n".encode() + b"\r\n00:00:05.000 --> 00:00:06.000\r\nbad \xff byte\r\n")
    (tmp_path / "v1" / "b.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nfirst\n42\nlast\n\n2\nno time\n")
    files = captions.read_caption_files(spark, str(tmp_path))
    got = {r["path"][-5:]: r["value"] for r in files.collect()}
    vtt = spark.createDataFrame([(1, got["a.vtt"])], "video_id long, value string")
    assert times(captions.parse_vtt(vtt), "text") == [(1.0, 2.0, "last & best"), (5.0, 6.0, "bad byte")]
    srt = spark.createDataFrame([(1, "b.srt", got["b.srt"])], "video_id long, path string, value string")
    assert times(captions.load_cues(srt), "text") == [(1.0, 2.0, "first last")]


def test_tables(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# list\n\nhttp://a #x\n http://b\nhttp://a\n")
    got = tables.read_url_list(tables.read_lines(spark, str(tmp_path / "urls.txt"))).orderBy("line_no").collect()
    assert [r["url"] for r in got] == ["http://a", "http://b"]
    (tmp_path / "seg.json").write_text('[{"video_id": 1, "idx": 0, "start_s": 0.5, "en": "a", "odd": 1}]')
    row = tables.read_segments(spark, str(tmp_path / "seg.json")).first()
    assert (row["idx"], row["start_s"], row["zh"]) == (0, 0.5, None)
    assert {r["length"] for r in tables.file_manifest(spark, str(tmp_path / "urls.txt")).collect()} == {39}


def test_listing_reads_names_and_sizes(spark, tmp_path):
    for video, name, size in (("v1", "source.en.vtt", 700), ("v1", "source.srt", 0), ("v 2", "clip%20 a.mp3", 600), ("v3", "source.srt", 500), ("v3", "clip%20 a.mp3", 499)):
        (tmp_path / "in" / video).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / video / name).write_bytes(b"x" * size)
    for video, at in (("v1", 100), ("v3", 200)):
        for f in (tmp_path / "in" / video).iterdir():
            os.utime(f, (at, at + (f.name == "source.srt")))
    files = tables.list_files(spark, str(tmp_path / "in"))
    assert sorted((r["video_id"], r["rel_path"], r["size_bytes"]) for r in files.collect()) == [("v 2", "clip%20 a.mp3", 600), ("v1", "source.en.vtt", 700), ("v3", "clip%20 a.mp3", 499), ("v3", "source.srt", 500)]
    plan = files.where("size_bytes >= 500")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(length,500)" in plan and "content" not in plan
    assert [r["video_id"] for r in captions.without_captions(tables.folder_sizes(files)).collect()] == ["v 2"]
    fresh = lambda source, artifact: {r["video_id"]: r["fresh"] for r in tables.fresh_artifacts(files, source, artifact).collect()}
    assert fresh("source.srt", "clip%20 a.mp3") == {"v 2": False, "v3": False} and fresh("clip%20 a.mp3", "source.srt") == {"v3": True}
    assert fresh("source.en.vtt", "source.en.vtt") == {"v1": True} and tables.fresh_artifacts(files.where("false"), "a", "b").count() == 0


def test_short_outputs(spark):
    rows = spark.createDataFrame([(100.0, 100.0), (95.0, 100.0), (100.3, 100.0)], "o double, s double")
    got = rows.select(timing.is_truncated(rows.o, rows.s), timing.cover_missing(rows.o, rows.s)).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False), (False, True)]


def test_json_files_of_all_layouts(spark, tmp_path):
    rows = [{"idx": n, "start": n * 1.5, "end": n + 1.0, "en": f"line {n} [é]", "zh": "", "other": [1, {"a": "}"}]} for n in range(4)]
    for video, text in ((1, json.dumps(rows, indent=2)), (2, json.dumps(rows)), (3, "\n".join(map(json.dumps, rows)) + "\n\n"), (4, "[]"), (5, "  \n" + json.dumps(rows, indent=1)), (6, '{"idx": 0, "start": 0.5, "video_id": 60}')):
        (tmp_path / "good" / str(video)).mkdir(parents=True)
        (tmp_path / "good" / str(video) / "segments.json").write_text(text)
    found = {}
    for r in tables.read_segments(spark, f"file://{tmp_path}/good").collect():
        found.setdefault(r["video_id"], []).append((r["idx"], r["start_s"], r["end_s"], r["en"], r["zh"], r["audio"]))
    want = [(r["idx"], r["start"], r["end"], r["en"], "", None) for r in rows]
    assert {v: sorted(x) for v, x in found.items()} == {1: want, 2: want, 3: want, 5: want, 60: [(0, 0.5, None, None, None, None)]}
    cues_read = tables.read_cues(spark, f"file://{tmp_path}/good/2").collect()
    assert [(r["video_id"], r["cue_no"], r["start_s"]) for r in sorted(cues_read, key=lambda r: r["cue_no"])] == [(2, n, n * 1.5) for n in range(4)]


def test_bad_json_is_told_and_never_empty(spark, tmp_path):
    whole = json.dumps([{"idx": 1, "start": 0.5}, {"idx": 2, "start": 1.5}], indent=2)
    for n, text in enumerate([whole[:-2], whole[:30], "", "not json", '{"idx": 1}\n{"idx": ', '"text"', "[1, 2]", whole]):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "segments.json").write_text(text)
    bad = sorted(int(r["path"].split("/")[-2]) for r in tables.unreadable_files(spark, f"file://{tmp_path}").collect())
    assert bad == list(range(7))
    assert {r["video_id"] for r in tables.read_segments(spark, f"file://{tmp_path}", strict=False).collect()} == {7}
    with pytest.raises(Exception, match="no JSON rows"):
        tables.read_segments(spark, f"file://{tmp_path}").collect()


def test_reset_asks_for_every_line_again(spark, tmp_path):
    fn, asked = counted(tmp_path / "calls", forgetful())
    table, store = lines(spark, 6), f"file://{tmp_path}/store"
    first = batches.translate(table, fn, store=store).count()
    n = len(asked())
    log = spark.createDataFrame([(1, 4, 1, "done")], "video_id long, ord int, seq long, status string")
    none = ledger.last_resets(ledger.reset_from(log, log, "tts", 2, F.current_timestamp()), "translate")
    assert none.count() == 0 and batches.translate(table, fn, store=store, resets=none).count() == first and len(asked()) == n
    resets = freeze(ledger.last_resets(ledger.reset_from(log, log, "merge", 2, F.current_timestamp()), "translate"))
    assert batches.translate(table, fn, store=store, resets=resets).count() == first and len(asked()) == 2 * n
    assert batches.translate(table, fn, store=store, resets=resets).count() == first and len(asked()) == 2 * n  # what was learned since counts
    other = table.withColumn("en", F.concat(F.lit("cut anew "), "en"))
    batches.translate(other, fn, store=store)
    assert len(asked()) == 3 * n


def test_ordered_tables_need_no_shuffle_by_video(spark):
    rows = spark.range(3000).select((F.col("id") % 70).alias("video_id"), (F.col("id") * 7 % 3001).alias("cue_no"), (F.col("id") * 1.0).alias("start_s"), (F.col("id") + 0.5).alias("end_s"), F.lit("some text.").alias("text"))
    table = documents.write_ordered(rows, "ordered_cues_test", "cue_no", buckets=6)
    try:
        plain = cues.pause_runs(rows)
        frame = cues.pause_runs(table)
        assert sorted(map(str, frame.collect())) == sorted(map(str, plain.collect()))
        for made in (frame, cues.out_of_order(table), segments.renumber(table, ["cue_no"], "n")):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning(video_id" not in plan and "Exchange" not in plan, plan
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        from pathlib import Path
        from urllib.parse import urlparse

        files = [Path(urlparse(f).path) for f in table.inputFiles()]
        assert len({f.name.split("_")[1].split(".")[0] for f in files}) == 6
    finally:
        spark.sql("DROP TABLE ordered_cues_test")


def test_cues_out_of_order_are_told(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (2, 0, 0.0, 9.0), (2, 1, 1.0, 2.0), (2, 2, 0.5, 10.0), (3, 0, None, 1.0), (3, 1, 0.0, None), (4, 0, 1.0, 2.0), (4, 1, 1.0, 2.0)]
    found = cues.out_of_order(spark.createDataFrame([(*r, "x") for r in rows], "video_id long, cue_no long, start_s double, end_s double, text string")).collect()
    assert [tuple(r) for r in found] == [(2, 3, 1, 1)]


def test_waits_grow_and_hopeless_errors_are_not_tried_again(monkeypatch):
    waits = []
    monkeypatch.setattr(batches.time, "sleep", waits.append)

    class Refused(Exception):
        retryable = False

    def fails(error):
        def call(payload):
            raise error

        return call

    assert batches.asked(fails(ValueError("busy")), "1. a", 1, 4, 5.0) == (None, "busy") and waits == [5.0, 10.0, 15.0]
    waits.clear()
    assert batches.asked(fails(Refused("no key")), "1. a", 1, 4, 5.0) == (None, "no key") and waits == []
    assert batches.asked(lambda p: "nothing", "1. a", 1, 3, 4.0) == ("nothing", None) and waits == [1.0, 2.0]
    waits.clear()
    assert batches.asked(lambda p: "1. x", "1. a", 1, 3, 4.0) == ("1. x", None) and waits == []


def test_killed_task_does_not_ask_again(spark, tmp_path):
    folder, kept = tmp_path / "calls", f"file://{tmp_path}/kept"
    folder.mkdir()

    def call(payload):
        import os

        (folder / uuid.uuid4().hex).write_text(payload)
        if len(list(folder.iterdir())) == 4:
            os._exit(1)  # the worker is gone in the midst of its fourth call
        return payload.replace(". ", ". 译")

    requests = batches.build_requests(batches.assign_batches(lines(spark, 70), 10))
    with pytest.raises(Exception):  # noqa: B017, PT011
        batches.apply_batches(requests, call, concurrency=1, kept=kept).collect()
    got = batches.apply_batches(requests, call, concurrency=1, kept=kept).collect()
    assert len(got) == 7 and all(r["error"] is None and r["body"].count("译") == 10 for r in got)
    asked = [f.read_text() for f in folder.iterdir()]
    assert len(asked) == 8 and len(set(asked)) == 7  # only the call in hand was made twice
    other = requests.withColumn("payload", F.concat("payload", F.lit("!")))
    batches.apply_batches(other, call, concurrency=1, kept=kept).collect()
    assert len(list(folder.iterdir())) == 15  # changed payloads are asked for


def test_replies_replace_each_other(spark, tmp_path):
    path = f"file://{tmp_path}/replies"
    table = lambda *rows: spark.createDataFrame(rows, REPLIES)
    now = lambda: sorted(tuple(r) for r in stores.read_replies(spark, path).collect())
    assert now() == []
    assert stores.write_replies(table((1, 0, "a"), (1, 1, "b"), (1, 1, "c"), (2, 0, None), (2, 0, "d"), (3, 0, None)), path, 2) == 1
    assert now() == [(1, 0, "a"), (1, 1, "c"), (2, 0, "d"), (3, 0, None)]
    assert stores.write_replies(table((1, 1, "A")), path, 2) == 2  # the later write counts, not the greater text
    want = [(1, 0, "a"), (1, 1, "A"), (2, 0, "d"), (3, 0, None)]
    assert now() == want
    assert stores.compact_replies(spark, path, 2) == 2 and now() == want
    assert spark.read.parquet(path).count() == 4 and stores.compact_replies(spark, path, 2) == 0
    assert stores.write_replies(table((2, 0, "e"), (4, 7, "f")), path, 2) == 3
    assert now() == [(1, 0, "a"), (1, 1, "A"), (2, 0, "e"), (3, 0, None), (4, 7, "f")]
    stores.write_replies(table(), path)
    assert len(now()) == 5


def test_compaction_that_dies_or_is_overtaken_loses_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/replies"
    table = lambda *rows: spark.createDataFrame(rows, REPLIES)
    now = lambda: sorted(tuple(r) for r in stores.read_replies(spark, path).collect())
    stores.write_replies(table((1, 0, "a"), (1, 1, "b")), path)
    stores.write_replies(table((1, 0, "c")), path)
    children = stores._children

    def overtaken(session, folder):
        out = children(session, folder)
        if not calls:
            stores.write_replies(table((1, 1, "meanwhile")), path)
        elif dies:
            raise KeyboardInterrupt
        calls.append(1)
        return out

    for dies in (True, False):
        calls = []
        with monkeypatch.context() as patch:
            patch.setattr(stores, "_children", overtaken)
            if dies:
                with pytest.raises(KeyboardInterrupt):
                    stores.compact_replies(spark, path)
            else:
                stores.compact_replies(spark, path)
        assert now() == [(1, 0, "c"), (1, 1, "meanwhile")]


def test_events_are_numbered_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    read = lambda: [tuple(r) for r in stores.read_ledger(spark, path).select("video_id", "seq", "ord", "status", "error", "run").orderBy("video_id", "seq").collect()]
    assert read() == []
    results = spark.createDataFrame([(1, None), (1, "b\nbad"), (1, "c"), (2, None), (2, None)], "video_id long, error string")
    events = ledger.stage_events(results, "translate")
    want = [(1, 1, 4, "running", None, "r1"), (1, 2, 4, "failed", "b bad", "r1"), (2, 1, 4, "running", None, "r1"), (2, 2, 4, "done", None, "r1")]
    stores.write_events(events.where("video_id = 2"), path, "r1")  # a write that got only so far
    stores.write_events(events, path, "r1")
    stores.write_events(events, path, "r1")
    assert read() == want
    stores.write_events(ledger.reset_events(spark.createDataFrame([(2,)], "video_id long"), "tts"), path, "reset 1")
    assert read() == [*want, *[(2, 3 + n, 5 + n, "pending", None, "reset 1") for n in range(3)]]
    log = stores.read_ledger(spark, path)
    assert {r["video_id"] for r in ledger.last_resets(log, "tts").collect()} == {2} and ledger.last_resets(log, "translate").count() == 0
    stores.write_events(ledger.stage_events(results.where("video_id = 1 and error is null"), "translate"), path, "r2")
    assert {r["video_id"]: r["status"] for r in ledger.latest_stage_status(log).where("ord = 4").collect()} == {1: "failed", 2: "done"}
    log = stores.read_ledger(spark, path)
    assert {r["video_id"]: r["status"] for r in ledger.latest_stage_status(log).where("ord = 4").collect()} == {1: "done", 2: "done"}
    odd = spark.createDataFrame([(None, "tts", "done"), (3, "no such stage", "done"), (3, None, "done"), (3, "tts", None)], "video_id long, stage string, status string")
    before = len(read())
    stores.write_events(odd, path, "r3")
    assert len(read()) == before


def test_only_folders_of_open_videos_are_read(spark, tmp_path):
    path = f"file://{tmp_path}/cues"
    rows = spark.range(400).select((F.col("id") % 40).alias("video_id"), F.col("id").alias("idx"), F.lit(0.0).alias("start_s"), F.lit(1.0).alias("end_s"), F.lit("x").alias("en"), F.lit("").alias("zh"))
    documents.write_segments(rows, path, buckets=8)
    log = spark.createDataFrame([(v, o, o, "failed" if v in (3, 11) and o == 4 else "done") for v in range(40) for o in range(8)], "video_id long, ord int, seq long, status string")
    frozen = freeze(log)
    found = ledger.rows_to_resume(spark.read.parquet(path), frozen, "translate", buckets=8)
    assert sorted({r["video_id"] for r in found.collect()}) == [3, 11] and found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(" in plan and "dynamicpruningexpression(true)" not in plan, plan
