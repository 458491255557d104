"""Reading caption files: choosing, parsing SRT and VTT, cue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.functions import timing
from cueloom.operators.cues import collapse_rolling, min_duration, suffix_delta

# Caption files of a video in order of preference.
PRIORITY = ["source.en.vtt", "source.en.srt", "source.vtt", "source.srt"]
_TIME = r"\d{2}:\d{2}:\d{2}[.,]\d{3}"
_RANGE = rf"({_TIME})\s*-->\s*({_TIME})"
_SETTING = r"(?i)^(align|position|size|line|vertical):.*$"


def read_caption_files(spark: SparkSession, path: str, id_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """(video_id, path, value) of whole files below path; the video is named by the folder. Bytes that are no UTF-8 are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{srt,vtt}").load(path)
    value = F.replace(F.make_valid_utf8(F.col("content")), F.lit("�"), F.lit(""))
    return files.select(F.regexp_extract("path", id_pattern, 1).alias("video_id"), "path", value.alias("value"))


def pick_caption_file(files: DataFrame) -> DataFrame:
    """(video_id, name) of the preferred caption file of each video that has one, from a manifest."""
    ranked = files.withColumn("_p", F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("name"))).where("_p > 0")
    return ranked.groupBy("video_id").agg(F.min_by("name", "_p").alias("name"))


def without_captions(files: DataFrame) -> DataFrame:
    return files.select("video_id").distinct().join(pick_caption_file(files), "video_id", "left_anti")


def is_shown(line: Column, drop_notes: bool) -> Column:
    """Whether a line of a cue's payload, without space at its ends, is shown: no blank or all-digit ones, and for VTT no notes or settings."""
    shown = (line != "") & ~line.rlike(r"(?U)^\p{Nd}+$")
    return shown & ~line.startswith("NOTE") & ~line.rlike(_SETTING) if drop_notes else shown


def _lines(payload: Column, drop_notes: bool) -> Column:
    """Visible lines of a cue's payload, cleaned."""
    lines = F.filter(F.transform(F.split(payload, r"\r\n|[\n\r]"), T.squeeze_ends), lambda x: is_shown(x, drop_notes))
    return F.filter(F.transform(lines, T.clean_caption_text), lambda x: x != "")


def _raw_cues(files: DataFrame, vtt: bool) -> DataFrame:
    text = F.regexp_replace("value", r"\r\n|\r", "\n")
    blocks = files.select("video_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("_block", "_b"))
    at = F.regexp_extract("_b", _RANGE, 0)
    payload = F.substr(F.col("_b"), F.instr(F.col("_b"), at) + F.length(at))
    cues = blocks.withColumn("_at", at).where("_at <> ''").select(
        "video_id", "_block", timing.ts_to_seconds(F.regexp_extract("_b", _RANGE, 1)).alias("start_s"), timing.ts_to_seconds(F.regexp_extract("_b", _RANGE, 2)).alias("end_s"), _lines(payload, vtt).alias("_lines")
    )
    shown = F.element_at("_lines", -1) if vtt else F.array_join("_lines", " ")
    cues = min_duration(cues).where(F.size("_lines") > 0)
    return cues.select("video_id", F.col("_block").cast("long").alias("cue_no"), "start_s", "end_s", shown.alias("text"))


def parse_srt(files: DataFrame) -> DataFrame:
    """Cues of SRT texts (video_id, value): all lines of a cue, joined. cue_no is the block's number in the file."""
    return _raw_cues(files, vtt=False)


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues of VTT texts before de-rolling: the last line of each cue."""
    return _raw_cues(files, vtt=True)


def load_cues(files: DataFrame, extend_to_next: bool = True) -> DataFrame:
    """Cues of caption files (video_id, path, value): SRT by suffix, all else as VTT with rolling captions collapsed."""
    srt = F.lower("path").endswith(".srt")
    vtt = suffix_delta(collapse_rolling(parse_vtt(files.where(~srt)), extend_to_next))
    return parse_srt(files.where(srt)).unionByName(vtt)
