"""Sentences and segments: splitting runs, sharing out time, packing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions import splitting
from cueloom.functions import text as T
from cueloom.functions import timing
from cueloom.functions.splitting import mid_sentence_cut, normalize
from cueloom.operators.cues import MAX_GAP, pause_runs
from cueloom.operators.folds import fold_groups


def sentence_units(runs: DataFrame, max_chars: int = 140) -> DataFrame:
    """(video_id, run_id, start_s, end_s, unit_no, text) of runs: sentences, and pieces of those longer than max_chars.

    start_s and end_s are still the run's. Sentences pass through Python once, in Arrow batches, and the runs are planned
    once and stay where they were grouped.
    """
    parts = runs.select("video_id", "run_id", "start_s", "end_s", F.posexplode(T.split_sentences(F.col("text"))).alias("_s", "_text"))
    parts = parts.withColumn("_pieces", splitting.long_split_column(max_chars)("_text"))
    parts = parts.select("video_id", "run_id", "start_s", "end_s", "_s", F.posexplode("_pieces").alias("_p", "text"))
    order = Window.partitionBy("video_id", "run_id").orderBy("_s", "_p")
    return parts.withColumn("unit_no", F.row_number().over(order).cast("long") - 1).drop("_s", "_p")


def allocate_times(units: DataFrame) -> DataFrame:
    """Share a run's time over its units by their number of characters; the last ends where the run does."""
    run = Window.partitionBy("video_id", "run_id")
    order = run.orderBy("unit_no")
    weight = F.greatest(F.lit(1), F.length("text"))
    u = units.withColumn("_sum", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(weight).over(run))
    end = F.least("end_s", F.col("start_s") + F.greatest(F.lit(0.05), F.col("end_s") - F.col("start_s")) * F.col("_sum") / F.col("_all"))
    u = u.withColumn("_end", F.when(F.col("_sum") == F.col("_all"), F.col("end_s")).otherwise(end))
    return u.withColumn("start_s", F.coalesce(F.lag("_end").over(order), F.col("start_s"))).withColumn("end_s", F.col("_end")).drop("_sum", "_all", "_end")


def glue_fragments(units: DataFrame, max_gap: float = MAX_GAP) -> DataFrame:
    """Join units to the one before where a cut would orphan a fragment; (video_id, run_id, sentence_no, ...).

    The test looks at the end of the text before only, so the unit before stands for all that is glued to it.
    """
    order = Window.partitionBy("video_id", "run_id").orderBy("unit_no")
    before, end = F.lag("text").over(order), F.lag("end_s").over(order)
    glued = F.coalesce((F.col("start_s") - end <= max_gap) & T.mid_sentence_cut(before, F.col("text")), F.lit(False))
    u = units.withColumn("_new", F.when(before.isNull() | ~glued, 1).otherwise(0))
    u = u.withColumn("sentence_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = u.groupBy("video_id", "run_id", "sentence_no").agg(F.min_by("start_s", "unit_no").alias("start_s"), F.max_by("end_s", "unit_no").alias("end_s"), F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct("unit_no", "text"))).alias("_u"))
    text = F.array_join(F.transform("_u", lambda x: x["text"]), " ")
    return joined.withColumn("text", F.when(F.col("_n") == 1, F.get("_u", 0)["text"]).otherwise(T.normalize_cue_text(text))).drop("_u", "_n")


Piece = tuple[float, float, str]


@dataclass(frozen=True)
class Limits:
    """What segments should be like: the target and greatest length in seconds and characters, and what counts as tiny."""

    max_gap: float = MAX_GAP
    target_len: float = 5.0
    max_len: float = 8.5
    max_chars: int = 140
    min_seg_dur: float = 1.4
    min_seg_words: int = 4

    def is_tiny(self, p: Piece) -> bool:
        return p[1] - p[0] < self.min_seg_dur or len(p[2].split()) < self.min_seg_words

    def within(self, p: Piece, times: float) -> bool:
        return p[1] - p[0] <= self.max_len * times and len(p[2]) <= int(self.max_chars * times)


def _joined(pieces: Iterable[Piece], max_gap: float, joins: Callable[[Piece, Piece, Piece], bool]) -> Iterator[Piece]:
    """Pieces with those joined to the one before that follow within max_gap and cut a sentence, or for which joins(before, piece, both) holds."""
    held = None
    for piece in pieces:
        if held and piece[0] - held[1] <= max_gap:
            both = (held[0], piece[1], normalize(f"{held[2]} {piece[2]}"))
            if mid_sentence_cut(held[2], piece[2]) or joins(held, piece, both):
                held = both
                continue
        if held:
            yield held
        held = piece
    if held:
        yield held


def _packed(units: Iterable[Piece], limits: Limits) -> Iterator[Piece]:
    """Units with fragments glued, and sentences packed up to the target length."""
    sentences = _joined(units, limits.max_gap, lambda a, b, both: False)
    for start, end, raw in _joined(sentences, limits.max_gap, lambda a, b, both: (limits.is_tiny(a) or a[1] - a[0] < limits.target_len) and limits.within(both, 1)):
        if text := normalize(raw):
            yield start, end, text


def _absorbed(pieces: Iterable[Piece], limits: Limits) -> Iterator[Piece]:
    """Pieces with tiny ones joined to a neighbour while both stay within a tenth over the limits."""
    return _joined(pieces, limits.max_gap, lambda a, b, both: (limits.is_tiny(a) or limits.is_tiny(b)) and limits.within(both, 1.1))


def pack_segments(units: DataFrame, max_gap: float = MAX_GAP, target_len: float = 5.0, max_len: float = 8.5, max_chars: int = 140, min_seg_dur: float = 1.4, min_seg_words: int = 4) -> DataFrame:
    """Segments of timed units: (video_id, idx, start_s, end_s, en). Runs are more than max_gap apart, so each is folded alone, piece by piece."""
    limits = Limits(max_gap, target_len, max_len, max_chars, min_seg_dur, min_seg_words)

    def packed(rows: Iterator[Piece]) -> Iterator[tuple[int, float, float, str]]:
        for n, piece in enumerate(_absorbed(_packed(rows, limits), limits)):
            yield n, *piece

    segments = fold_groups(units, ["video_id", "run_id"], ["unit_no"], ["start_s", "end_s", "text"], packed, "video_id long, run_id long, part long, start_s double, end_s double, en string")
    return renumber(segments, ["run_id", "part"]).drop("run_id", "part")


def absorb_micro(segments: DataFrame, max_gap: float = MAX_GAP, max_len: float = 8.5, max_chars: int = 140, min_seg_dur: float = 1.4, min_seg_words: int = 4) -> DataFrame:
    """Segments (video_id, idx, start_s, end_s, en) with tiny ones joined to a neighbour, numbered anew."""
    limits = Limits(max_gap, 0.0, max_len, max_chars, min_seg_dur, min_seg_words)

    def absorbed(rows: Iterator[Piece]) -> Iterator[tuple[int, float, float, str]]:
        for n, piece in enumerate(_absorbed(rows, limits)):
            yield n, *piece

    return fold_groups(segments, ["video_id"], ["idx"], ["start_s", "end_s", "en"], absorbed, "video_id long, idx int, start_s double, end_s double, en string")


def renumber(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Dense numbers from 0 in each video."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("video_id").orderBy(*order)) - 1)


def segment_cues(cues: DataFrame, max_chars: int = 140) -> DataFrame:
    """Cues to packed segments. Runs without text give none."""
    runs = pause_runs(cues).where(F.col("text") != "")
    return pack_segments(allocate_times(sentence_units(runs, max_chars)), max_chars=max_chars)


def segment_stats(segments: DataFrame) -> DataFrame:
    """Per video: number, mean and longest duration of segments, in milliseconds."""
    ms = timing.millis(F.col("end_s")) - timing.millis(F.col("start_s"))
    return segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("segments"), F.floor(F.sum(ms) / F.count(F.lit(1))).cast("bigint").alias("mean_ms"), F.max(ms).alias("max_ms"))


def slot_with_lead(segments: DataFrame, most: float = 0.35) -> DataFrame:
    """Add slot_s: a segment's own time and up to most seconds of the silence after it."""
    following = F.lead("start_s").over(Window.partitionBy("video_id").orderBy("idx"))
    lead = F.when(following > F.col("end_s"), F.least(F.lit(most), following - F.col("end_s"))).otherwise(0.0)
    return segments.withColumn("slot_s", timing.slot(F.col("start_s"), F.col("end_s")) + lead)


def english_only(segments: DataFrame) -> DataFrame:
    """Segments with every derived column at its default."""
    return segments.select("video_id", F.col("idx").cast("int").alias("idx"), "start_s", "end_s", "en", F.lit("").alias("zh"), F.lit(0).alias("rate_pct"), F.lit("").alias("audio"), F.lit(0.0).alias("tts_dur"), F.lit(False).alias("fitted"), F.lit("").alias("note"))
