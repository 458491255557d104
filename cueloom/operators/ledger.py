"""The run ledger: stage history as rows, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.schemas import STAGES

OPEN = ("pending", "failed", "running")
#: The order in which the events of one stage of one run are numbered.
STATUS_ORDER = ["pending", "running", "done", "failed"]
#: A stored event: seq is its place among the video's events, run the run that wrote it.
EVENTS = "video_id long, ord int, seq long, status string, at timestamp, error string, retryable boolean, detail map<string,string>, run string"
# The details that a status report shows, in order.
DETAIL_KEYS = ["segments", "total", "done_batches", "audio_ok", "missing", "out", "progress", "cues", "overflow", "duration", "size_mb"]


def with_ord(ledger: DataFrame) -> DataFrame:
    """Add ord, the place of the stage."""
    return ledger.withColumn("ord", F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")).cast("int") - 1)


def with_stage(ledger: DataFrame) -> DataFrame:
    """Add stage, the name at place ord."""
    return ledger.withColumn("stage", F.get(F.array(*map(F.lit, STAGES)), F.col("ord")))


def all_stages(videos: DataFrame) -> DataFrame:
    """Each video with each of the eight stages."""
    stages = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)])
    return videos.select("video_id").distinct().select("video_id", F.explode(stages).alias("_s")).select("video_id", "_s.ord", "_s.stage")


def latest_stage_status(ledger: DataFrame) -> DataFrame:
    """(video_id, ord, stage, status): the last status by seq, pending where there is none."""
    latest = ledger.groupBy("video_id", "ord").agg(F.max_by("status", "seq").alias("_status"), F.max("seq").alias("seq"))
    return all_stages(ledger).join(latest, ["video_id", "ord"], "left").select("video_id", "ord", "stage", F.coalesce("_status", F.lit("pending")).alias("status"), "seq")


def next_pending(ledger: DataFrame) -> DataFrame:
    """Per video the first stage in order that is not done; null if all are."""
    return latest_stage_status(ledger).groupBy("video_id").agg(F.min_by("stage", F.when(F.col("status").isin(*OPEN), F.col("ord"))).alias("next_stage"))


def reset_from(ledger: DataFrame, videos: DataFrame, stage: str, seq: int, at: Column | None = None) -> DataFrame:
    """The ledger with pending rows appended for stage and all later ones of these videos.

    With at, rows carry that time (a timestamp) and older ones the ledger's own, null if it has none; last_resets()
    finds it, and whoever reads what earlier runs stored leaves out what is older.
    """
    later = all_stages(videos).where(F.col("ord") >= STAGES.index(stage))
    columns, more = ["video_id", "ord", "seq", "status"], []
    if at is not None:
        ledger = ledger if "at" in ledger.columns else ledger.withColumn("at", F.lit(None).cast("timestamp"))
        columns, more = [*columns, "at"], [at.alias("at")]
    return ledger.select(*columns).unionByName(later.select("video_id", "ord", F.lit(seq).cast("long").alias("seq"), F.lit("pending").alias("status"), *more))


def stage_events(results: DataFrame, stage: str) -> DataFrame:
    """Start and end of a stage as events (video_id, stage, status, error), from its result table with video_id and error.

    A video may have many rows (batches, say): it has failed if any has an error, and then shows the smallest one, on
    one line of at most 300 characters; else it is done.
    """
    one = results.groupBy("video_id").agg(F.min("error").alias("error")).withColumn("error", _one_line(F.col("error")))
    ends = F.struct(F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), "error")
    starts = F.struct(F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"))
    return one.select("video_id", F.lit(stage).alias("stage"), F.explode(F.array(starts, ends)).alias("_e")).select("video_id", "stage", "_e.status", "_e.error")


def reset_events(videos: DataFrame, stage: str) -> DataFrame:
    """Pending events of stage and all later ones, to be written: a reset that last_resets() finds in the ledger read back."""
    return all_stages(videos).where(F.col("ord") >= STAGES.index(stage)).select("video_id", "stage", F.lit("pending").alias("status"))


def last_resets(ledger: DataFrame, stage: str) -> DataFrame:
    """(video_id, reset_at): when each video was last sent back to this stage or to one before it."""
    sent_back = (F.col("ord") == STAGES.index(stage)) & (F.col("status") == "pending") & F.col("at").isNotNull()  # a reset marks all later stages too
    return ledger.where(sent_back).groupBy("video_id").agg(F.max("at").alias("reset_at"))


def job_status(ledger: DataFrame) -> DataFrame:
    """Per video: done when all stages are; failed if the last event is; pending without events; else running."""
    state = latest_stage_status(ledger).groupBy("video_id").agg(F.min(F.col("status") == "done").alias("_done"), F.max_by("status", "seq").alias("_last"))
    status = F.when(F.col("_done"), "done").when(F.col("_last") == "failed", "failed").when(F.col("_last") == "pending", "pending").otherwise("running")
    return state.select("video_id", F.coalesce(status, F.lit("pending")).alias("status"))


def status_report(ledger: DataFrame) -> DataFrame:
    """One line of text for each video and stage: status, and the chosen details of its map column detail."""
    latest = ledger.groupBy("video_id", "ord").agg(F.max_by("detail", "seq").alias("_d"), F.max_by("error", "seq").alias("error"))
    shown = F.filter(F.transform(F.array(*map(F.lit, DETAIL_KEYS)), lambda k: F.concat(k, F.lit("="), F.element_at("_d", k))), lambda x: x.isNotNull())
    both = latest_stage_status(ledger).join(latest, ["video_id", "ord"], "left")
    return both.select("video_id", "ord", F.concat_ws("  ", F.col("stage"), F.col("status"), F.nullif(F.array_join(F.coalesce(shown, F.array().cast("array<string>")), ", "), F.lit(""))).alias("line"), "error")


def job_report(ledger: DataFrame) -> DataFrame:
    """(video_id, line_no, line): what stands above and below the stage lines: status, stage, updated, and error, retryable and resume where they apply.

    The ledger has seq, status, at (text), error and retryable; the last event tells stage and time, and its error
    counts only while it is a failure. A job that is not done resumes at its first open stage.
    """
    last = with_stage(ledger).groupBy("video_id").agg(F.max_by(F.struct("stage", "status", "at", "error", "retryable"), "seq").alias("_l"))
    jobs = last.join(job_status(ledger), "video_id").join(next_pending(ledger), "video_id")
    failed = F.col("_l.status") == "failed"
    lines = F.array(
        F.concat(F.lit("status   "), "status"), F.concat(F.lit("stage    "), "_l.stage"), F.concat(F.lit("updated  "), "_l.at"),
        F.when(failed, F.concat(F.lit("error    "), F.coalesce("_l.error", F.lit("")))), F.when(failed & F.col("_l.retryable"), F.lit("retryable yes")), F.concat(F.lit("resume   "), "next_stage"),
    )
    return jobs.select("video_id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line"))


def merge_meta(updates: DataFrame) -> DataFrame:
    """(video_id, key, value): of each key the value with the greatest seq."""
    return updates.groupBy("video_id", "key").agg(F.max_by("value", "seq").alias("value"))


def rows_to_resume(stored: DataFrame, ledger: DataFrame, stage: str, buckets: int = 64) -> DataFrame:
    """Of a table stored in folders by bucket of video_id, the rows of videos for which stage is not done.

    Two semi-joins: the buckets with open videos, of which there are at most as many as folders, prune the folders that are
    read while the query runs; then the videos themselves are met within these.
    """
    undone = latest_stage_status(ledger).where((F.col("stage") == stage) & (F.col("status") != "done")).select("video_id")
    folders = undone.select(F.pmod("video_id", F.lit(buckets)).cast("int").alias("bucket")).distinct()
    return stored.join(F.broadcast(folders), "bucket", "left_semi").join(undone, "video_id", "left_semi")


def resume_skip(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """Work (video_id, ord) without what the ledger's last status says is done."""
    done = latest_stage_status(ledger).where("status = 'done'").select("video_id", "ord")
    return work.join(done, ["video_id", "ord"], "left_anti")


def run_summary(runs: DataFrame) -> DataFrame:
    """One row over a list of runs (url, status, elapsed_s): ok, failed, total, seconds and the exit code."""
    failed = F.count(F.when(F.col("status") == "failed", 1))
    return runs.agg(F.count(F.when(F.col("status") == "done", 1)).alias("ok"), failed.alias("failed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("elapsed_s"), F.lit(0)).alias("elapsed_s"), F.when(failed > 0, 1).otherwise(0).alias("exit_code"))


def append_failed(runs: DataFrame) -> DataFrame:
    """(url, error) of failed runs, each error on one line of at most 300 characters."""
    return runs.where("status = 'failed'").select("url", _one_line(F.col("error")).alias("error"))


def _one_line(error: Column) -> Column:
    line = F.trim(F.regexp_replace(error, r"[\r\n]+", " "))
    return F.when(F.length(line) > 300, F.concat(F.substring(line, 1, 297), F.lit("..."))).otherwise(line)
