"""Cue tables: clipping, rolling captions, pause runs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import text as T
from cueloom.operators.folds import fold_groups
from cueloom.schemas import CUES

MAX_GAP = 0.75


def min_duration(cues: DataFrame, least: float = 0.05) -> DataFrame:
    return cues.where(F.col("end_s") - F.col("start_s") >= least)


def clip_window(cues: DataFrame, end_s: float, start_s: float = 0.0) -> DataFrame:
    """The parts of cues inside [start_s, end_s]; cues outside go. Put it before pause_runs, which it cannot pass."""
    inside = cues.where((F.col("end_s") > start_s) & (F.col("start_s") < end_s))
    return inside.withColumns({"start_s": F.greatest("start_s", F.lit(start_s)), "end_s": F.least("end_s", F.lit(end_s))})


def overlap_filter(segments: DataFrame, end_s: float, start_s: float = 0.0) -> DataFrame:
    """Segments that overlap the window, unchanged."""
    return segments.where((F.col("end_s") > start_s) & (F.col("start_s") < end_s))


def with_runs(cues: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """Add run_id: cues of a video whose gaps to the cue before are at most max_gap share one."""
    order = Window.partitionBy("video_id").orderBy("cue_no")
    breaks = F.when(F.col("start_s") - F.lag("end_s").over(order) > max_gap, 1).otherwise(0)
    return cues.withColumn("_break", breaks).withColumn("run_id", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def pause_runs(cues: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """One row per run: first start, end of the last cue, number of cues and the normalised text.

    One sort by video and cue serves both window steps; the grouping that follows reuses its partitioning.
    """
    runs = with_runs(cues, max_gap).groupBy("video_id", "run_id").agg(
        F.min_by("start_s", "cue_no").alias("start_s"), F.max_by("end_s", "cue_no").alias("end_s"), F.count(F.lit(1)).alias("n_cues"),
        F.array_sort(F.collect_list(F.struct("cue_no", "text"))).alias("_cues"),
    )
    return runs.withColumn("text", T.normalize_cue_text(F.array_join(F.transform("_cues", lambda c: c["text"]), " "))).drop("_cues")


def out_of_order(cues: DataFrame) -> DataFrame:
    """(video_id, n_cues, n_backward, n_nested) of videos whose cues are not in order of time, which pause_runs takes for granted.

    A cue is backward if it starts before the one before it, and nested if it ends before some earlier one does. Null times are
    neither. One sort by video and cue serves both.
    """
    order = Window.partitionBy("video_id").orderBy("cue_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    told = cues.select("video_id", (F.col("start_s") < F.lag("start_s").over(order)).alias("_back"), (F.col("end_s") < F.max("end_s").over(before)).alias("_nested"))
    out = told.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_cues"), F.count(F.when(F.col("_back"), 1)).alias("n_backward"), F.count(F.when(F.col("_nested"), 1)).alias("n_nested"))
    return out.where("n_backward + n_nested > 0")


def _fold(cues: DataFrame, step) -> DataFrame:
    """Fold each video's cues in order, numbering what comes out."""

    def numbered(rows: Iterator[tuple[float, float, str | None]]) -> Iterator[tuple[int, float, float, str]]:
        for n, cue in enumerate(step((start, end, text or "") for start, end, text in rows)):
            yield n, *cue

    return fold_groups(cues, ["video_id"], ["cue_no"], ["start_s", "end_s", "text"], numbered, CUES)


def collapse_rolling(cues: DataFrame, extend_to_next: bool = True) -> DataFrame:
    """Join consecutive cues of which one text is a prefix of the other, ignoring case; the longer text stays.

    A cue that is closed by the next one ends no earlier than that starts, which leaves no pauses; with
    extend_to_next=False it keeps its own end. The comparison is with the longest text so far, so this is a fold.
    """

    def step(rows: Iterator[tuple[float, float, str]]) -> Iterator[tuple[float, float, str]]:
        held = None
        for start, end, text in rows:
            if held:
                old, new = (" ".join(t.split()).lower() for t in (held[2], text))
                if new.startswith(old) or old.startswith(new):
                    held = (held[0], max(held[1], end), text if len(text) >= len(held[2]) else held[2])
                    continue
                yield held[0], max(held[1], start) if extend_to_next else held[1], held[2]
            held = (start, end, text)
        if held:
            yield held

    return _fold(cues, step)


def suffix_delta(cues: DataFrame) -> DataFrame:
    """Of cues that repeat the full text before them and add to it, only what is new; nothing new gives no cue."""

    def step(rows: Iterator[tuple[float, float, str]]) -> Iterator[tuple[float, float, str]]:
        full = ""
        for start, end, text in rows:
            text = " ".join(text.split())
            grown = bool(full) and text.startswith(full)
            new = text[len(full) :].strip(" ,.-") if grown else text
            if new or not grown:
                full = text
                yield start, end, new

    return _fold(cues, step)
