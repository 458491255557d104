"""Placing clips on a timeline; where they overlap the later one is heard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 24_000
#: Intervals and clips meet within stretches of so many samples, so a long video costs no more for each clip than a short one.
STRETCH = 10 * SAMPLES


def timeline_overlay(clips: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(video_id, from_sample, to_sample, seq) of what is heard; seq null is silence.

    clips are (video_id, seq, start_s, end_s); totals (video_id, total_s) says where each timeline ends, else it ends
    with its last clip. Starts and lengths are rounded to samples. Clips are cut into stretches, where they meet the
    elementary intervals between all boundaries; the greatest seq that covers an interval wins and equal neighbours
    are joined.
    """
    start = F.rint(F.col("start_s") * SAMPLES).cast("bigint")
    placed = clips.select("video_id", "seq", start.alias("a"), (start + F.rint((F.col("end_s") - F.col("start_s")) * SAMPLES).cast("bigint")).alias("b"))
    if totals is None:
        ends = placed.groupBy("video_id").agg(F.max("b").alias("total"))
    else:
        ends = totals.select("video_id", F.greatest(F.lit(1), F.rint(F.col("total_s") * SAMPLES)).cast("bigint").alias("total"))
    placed = placed.join(ends, "video_id").withColumn("b", F.least("b", "total")).where("a < b")
    cuts = ends.join(placed.drop("total"), "video_id", "left").select("video_id", F.explode(F.array(F.lit(0).cast("bigint"), "total", "a", "b")).alias("at")).where("at is not null")
    order = Window.partitionBy("video_id").orderBy("at")
    pieces = cuts.distinct().withColumn("to", F.lead("at").over(order)).where("to is not null").select("video_id", F.col("at").alias("from_sample"), F.col("to").alias("to_sample"))
    own = pieces.withColumn("_k", F.floor(F.col("from_sample") / STRETCH))
    covering = placed.withColumn("_k", F.explode(F.sequence(F.floor(F.col("a") / STRETCH), F.floor((F.col("b") - 1) / STRETCH))))
    heard = own.join(covering.drop("total"), ["video_id", "_k"], "left").groupBy("video_id", "from_sample", "to_sample").agg(F.max(F.when((F.col("a") <= F.col("from_sample")) & (F.col("b") >= F.col("to_sample")), F.col("seq"))).alias("seq"))
    line = Window.partitionBy("video_id").orderBy("from_sample")
    changed = heard.withColumn("_new", F.when(F.lag("seq").over(line).eqNullSafe(F.col("seq")) & (F.row_number().over(line) > 1), 0).otherwise(1))
    islands = changed.withColumn("_island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("video_id", "_island").agg(F.min("from_sample").alias("from_sample"), F.max("to_sample").alias("to_sample"), F.first("seq").alias("seq")).drop("_island")
