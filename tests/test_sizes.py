"""What keeps disk, memory and time of the timed-text queries in proportion to their input."""

import os
import time

import pytest
from pyspark.sql import functions as F

from cueloom import checkpoints
from cueloom.plans import fixtures, queries
from cueloom.schemas import REPLIES
from cueloom.sinks import documents, stores

SMALL = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_words_of_equal_ids_are_one_video_in_order(spark, tmp_path):
    rows = [(1, "a b c d e f g h"), (2, "  x \n\n y\n "), (3, None), (4, ""), (7, "b b b b b b b z"), (7, "a c"), (None, "n"), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {(r["video_id"], r["cue_no"]): r["text"] for r in fixtures.cues(spark, f"file://{tmp_path}").collect()}
    assert found == {(1, 0): "a b c d e f g", (1, 1): "h", (2, 0): "x y ", (4, 0): "", (7, 0): "a b b c b b b b b", (7, 1): "z", (None, 0): "n"}


@pytest.fixture
def no_broadcast(spark):
    with checkpoints.settings(spark, autoBroadcastJoinThreshold="-1"):
        yield


@pytest.mark.parametrize(("name", "most"), [("missing_lines", 2), ("merge_refill", 1), ("attach_translation", 2), ("split_failed", 1), ("timeline_overlay", 2), ("segment_cues", 3)])
def test_only_whole_texts_are_shuffled(spark, no_broadcast, name, most):
    exchanges = [line for line in plan_of(queries.QUERIES[name](spark, SMALL)).split("\n") if " Exchange " in line]
    texts = {line.split("hashpartitioning(")[1].split("#")[0] for line in exchanges}
    assert texts <= ({"doc_id"} if name != "segment_cues" else {"doc_id", "video_id"}), exchanges


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f for top, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_") and f.endswith(".data")}
    before = files()
    checkpoints.freeze(spark.range(1000).repartition(3, "id"), "t")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_replies_are_shuffled_once(spark, tmp_path):
    key, rows = ["video_id", "batch_no"], spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (2, 0, None)], REPLIES)
    frame = stores._last(stores._dealt(rows, key, 4), ["bucket", *key], F.col("body").desc_nulls_last())
    assert plan_of(frame).count("Exchange") == 1 and sorted(tuple(r)[:3] for r in frame.collect()) == [(1, 0, "b"), (2, 0, None)]


def test_compaction_reads_no_folder_without_a_last_reply(spark, tmp_path, monkeypatch):
    path, read = f"file://{tmp_path}/replies", []
    for text in ("old", "new"):
        stores.write_replies(spark.createDataFrame([(v, 0, text) for v in range(200)], REPLIES), path)
    add = stores._add
    monkeypatch.setattr(stores, "_add", lambda rows, *a: (read.append(plan_of(rows)), add(rows, *a))[1])
    assert stores.compact_replies(spark, path) == 2
    assert len(read) == 1 and "PartitionFilters: []" not in read[0]
    assert {(r["video_id"], r["body"]) for r in stores.read_replies(spark, path).collect()} == {(v, "new") for v in range(200)}


@pytest.mark.parametrize("name", ["file_listing", "captions_of_listing", "fresh_artifacts", "read_segment_files", "read_cue_files", "unreadable_files"])
def test_files_of_few_videos_are_there_at_once(spark, monkeypatch, name):
    whole = sorted(map(str, queries.QUERIES[name](spark, SMALL).collect()))
    there, write, put = [], documents.write_files, {}

    def counted(files, path, *more):
        put[path] = put.get(path, 0) + write(files, path, *more)
        there.append((path, [p for p in put if checkpoints.exists(spark, p)]))
        return put[path]

    monkeypatch.setattr(documents, "write_files", counted)
    monkeypatch.setattr(queries, "WAVE", 40)
    assert sorted(map(str, queries.QUERIES[name](spark, SMALL).collect())) == whole
    assert len(put) == 5 and all(alive == [path] for path, alive in there) and not any(checkpoints.exists(spark, p) for p in put)


def test_segments_are_written_in_files_that_are_small_enough_to_parse(spark, monkeypatch):
    monkeypatch.setattr(queries, "ROWS_PER_FILE", 100)
    files = queries.read_segments(spark, SMALL).inputFiles()
    rows = fixtures.cues(spark, SMALL).count()
    assert len(files) >= rows / 100 and max(spark.read.text(f).count() for f in files[:5]) <= 100
