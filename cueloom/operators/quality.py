"""Audio files, validation reports, coverage and retention, over manifests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.functions import timing

LEAST_BYTES = 500


def audio_candidates(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of each segment with their priority: its own name, the recorded path, then trial files by name.

    The segment number is parsed from the file name, so files and segments meet in an equi-join.
    """
    number = F.regexp_extract("name", r"^seg_(\d{4,})(?:_r.*)?\.mp3$", 1)
    files = manifest.withColumn("idx", F.when(number != "", number.cast("long"))).where("idx is not null")
    files = files.withColumn("priority", F.when(F.col("name").contains("_r"), 2).otherwise(0))
    named = files.join(segments.select("video_id", F.col("idx").cast("long").alias("idx"), "zh"), ["video_id", "idx"])
    recorded = segments.where(F.col("audio") != "").select("video_id", F.col("idx").cast("long").alias("idx"), "zh", F.element_at(F.split("audio", "/"), -1).alias("name"))
    recorded = recorded.join(manifest, ["video_id", "name"]).withColumn("priority", F.lit(1))
    columns = ["video_id", "idx", "zh", "name", "size_bytes", "dur", "priority"]
    return named.select(*columns).unionByName(recorded.select(*columns))


def match_audio(segments: DataFrame, manifest: DataFrame, least_dur: float | None = None) -> DataFrame:
    """(video_id, idx, name, size_bytes, dur): the first large enough candidate of each segment; with least_dur, also longer than that."""
    good = audio_candidates(segments, manifest).where(F.col("size_bytes") >= LEAST_BYTES)
    if least_dur is not None:
        good = good.where(F.col("dur") > least_dur)
    order = Window.partitionBy("video_id", "idx").orderBy("priority", "name")
    return good.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("video_id", "idx", "name", "size_bytes", "dur")


def attach_audio(segments: DataFrame, manifest: DataFrame, folder: str = "audio") -> DataFrame:
    """Segments with the path of the audio file that was found for each; those without one keep what is recorded."""
    found = match_audio(segments, manifest).select("video_id", "idx", F.concat(F.lit(folder + "/"), "name").alias("_found"))
    rows = segments.withColumn("_idx", F.col("idx").cast("long")).join(found.withColumnRenamed("idx", "_idx"), ["video_id", "_idx"], "left")
    return rows.withColumn("audio", F.coalesce("_found", "audio")).select(*segments.columns)


def missing_audio(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    need = segments.where(~T.is_blank(F.col("zh"))).select("video_id", F.col("idx").cast("long").alias("idx"))
    return need.join(match_audio(segments, manifest), ["video_id", "idx"], "left_anti")


def validation_report(segments: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per video: segments, lines with text, with audio, overflow, missing numbers in order, and pass."""
    found = match_audio(segments, manifest).select("video_id", "idx", F.lit(1).alias("_ok"))
    rows = segments.withColumn("idx", F.col("idx").cast("long")).join(found, ["video_id", "idx"], "left")
    need = ~T.is_blank(F.col("zh"))
    count = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("segments"), count(need).alias("zh_nonempty"), count(need & F.col("_ok").isNotNull()).alias("audio_ok"),
        F.array_sort(F.collect_list(F.when(need & F.col("_ok").isNull(), F.col("idx")))).alias("audio_missing"), F.array().cast("array<bigint>").alias("audio_bad"), count(F.col("note") == "overflow").alias("overflow"),
    )
    return out.withColumn("pass", (F.size("audio_missing") == 0) & (F.col("zh_nonempty") > 0))


def sample_missing(missing: DataFrame, k: int = 8) -> DataFrame:
    """The first k missing numbers of each video."""
    first = Window.partitionBy("video_id").orderBy("idx")
    few = missing.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    return few.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("idx")), lambda x: x.cast("string")), ",").alias("sample"))


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """New segments with the old line at the same place where theirs is blank, if both have as many segments and the old line is real."""
    counts = new.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n")).join(old.groupBy("video_id").agg(F.count(F.lit(1)).alias("_o")), "video_id").where("_n = _o").select("video_id")
    real = old.where(~T.is_blank(F.col("zh")) & ~T.is_untranslated(F.col("zh"), F.col("en"))).join(counts, "video_id", "left_semi").select("video_id", "idx", T.squeeze_ends(F.col("zh")).alias("_zh"))
    return new.join(real, ["video_id", "idx"], "left").withColumn("zh", F.when(T.is_blank(F.col("zh")), F.coalesce("_zh", "zh")).otherwise(F.col("zh"))).drop("_zh")


def upsert_window(full: DataFrame, processed: DataFrame) -> DataFrame:
    """The full table with the processed rows in place of those with their keys."""
    return full.join(processed.select("video_id", "idx"), ["video_id", "idx"], "left_anti").unionByName(processed.select(*full.columns))


def retention_plan(manifest: DataFrame, preview: bool = False) -> DataFrame:
    """Per video what cleaning would keep and drop: keep_name, victims, freed_bytes, verdict.

    manifest has one row per file or folder (video_id, name, size_bytes, dur). Refused: no output, one under 1000
    bytes, shorter than 1 s, or clearly shorter than the source.
    """
    first, other = ("out_preview.mp4", "out.mp4") if preview else ("out.mp4", "out_preview.mp4")
    value = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    per = manifest.groupBy("video_id").agg(
        value(first, "size_bytes").alias("_s1"), value(first, "dur").alias("_d1"), value(other, "size_bytes").alias("_s2"), value(other, "dur").alias("_d2"),
        F.coalesce(value("source.mp4", "dur"), value("source_full.mp4", "dur")).alias("_src"), F.count(F.lit(1)).alias("_all"), F.sum("size_bytes").alias("_bytes"),
    )
    use_first = F.col("_s1").isNotNull()
    size, dur = F.when(use_first, F.col("_s1")).otherwise(F.col("_s2")), F.when(use_first, F.col("_d1")).otherwise(F.col("_d2"))
    verdict = F.when(size.isNull() | (size < 1000), "missing output").when(dur < 1.0, "too short").when((F.col("_src") > 0) & timing.is_truncated(dur, F.col("_src")), "truncated").otherwise("ok")
    kept = F.when(use_first, F.lit(first)).when(F.col("_s2").isNotNull(), F.lit(other))
    return per.select("video_id", kept.alias("keep_name"), (F.col("_all") - F.when(kept.isNotNull(), 1).otherwise(0)).alias("victims"), (F.col("_bytes") - F.coalesce(size, F.lit(0))).alias("freed_bytes"), verdict.alias("verdict"))


def infer_done(manifest: DataFrame, coverage: DataFrame, report: DataFrame) -> DataFrame:
    """(video_id, stage) rows of stages that the existing files show to be done.

    manifest as for retention_plan, coverage from translation_coverage, report from validation_report.
    """
    has = lambda *names: F.max(F.col("name").isin(*names))
    value = lambda name: F.max(F.when(F.col("name") == name, F.col("dur")))
    per = manifest.groupBy("video_id").agg(
        has("source_full.mp4", "source.mp4").alias("video"), has("source.en.vtt", "source.en.srt").alias("captions"), has("source.mp4").alias("source"), has("segments.json").alias("listed"), has("narration.wav").alias("narration"),
        F.coalesce(value("out.mp4"), value("out_preview.mp4")).alias("out_dur"), has("out.mp4", "out_preview.mp4").alias("out"), value("source.mp4").alias("src_dur"),
    )
    joined = per.join(coverage.select("video_id", "complete", "lines"), "video_id", "left").join(report.select("video_id", "pass"), "video_id", "left")
    segments = F.col("listed") & (F.coalesce("lines", F.lit(0)) > 0)
    whole = ~F.coalesce((F.col("src_dur") > 0) & timing.is_truncated(F.col("out_dur"), F.col("src_dur")), F.lit(False))
    tests = [
        ("download", F.col("video") & F.col("captions")), ("prepare_video", F.col("source")), ("prepare_cues", segments), ("merge", segments), ("translate", segments & F.col("complete")),
        ("tts", segments & F.col("pass")), ("narration", F.col("narration")), ("compose", F.col("out") & whole),
    ]
    stages = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(s)) for s, t in tests])
    return joined.select("video_id", F.explode(stages).alias("stage")).where("stage is not null")


def live_check(status: DataFrame, report: DataFrame, k: int = 10) -> DataFrame:
    """Each video's recorded status next to what its files show."""
    shown = report.select("video_id", "segments", "zh_nonempty", "audio_ok", F.array_join(F.transform(F.slice("audio_missing", 1, k), lambda x: x.cast("string")), ",").alias("missing_sample"))
    return status.join(shown, "video_id", "left")
