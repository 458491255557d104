"""Choosing among measured trials of spoken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.functions import timing


def choose_trial(trials: DataFrame, slots: DataFrame, max_rate: int = 30) -> DataFrame:
    """The accepted trial of each segment: (video_id, idx, cand_no, rate_pct, dur, note).

    trials has one row per candidate text and speed (video_id, idx, cand_no, fast 0 or 1, dur, failed 0 or 1), slots
    has slot_s. Candidates are tried in order. One whose plain call failed is skipped. It is accepted plain if it
    fits within 2 %; else sped up if that fits, or if it is the last candidate; if the sped-up call failed, its plain
    trial is accepted. If none is accepted, the shortest of all trials that were made is taken; if all plain calls
    failed there is no audio.
    """
    by_cand = trials.groupBy("video_id", "idx", "cand_no").agg(
        F.max(F.when((F.col("fast") == 0) & (F.col("failed") == 0), F.col("dur"))).alias("d0"), F.max(F.when((F.col("fast") == 1) & (F.col("failed") == 0), F.col("dur"))).alias("d1")
    )
    joined = by_cand.join(slots.select("video_id", "idx", "slot_s"), ["video_id", "idx"])
    d0, d1, slot = F.col("d0"), F.col("d1"), F.col("slot_s")
    rate = timing.fit_rate(d0, slot, max_rate)
    plain = d0 <= slot * 1.02
    by_rate = F.when(plain | d1.isNull(), 0).otherwise(rate)
    dur = F.when(plain | d1.isNull(), d0).otherwise(d1)
    fits = plain | d1.isNull() | timing.fits(d1, slot)
    shorter = F.when(~plain & (d1 < d0), F.struct(d1.alias("dur"), F.col("cand_no"), rate.alias("rate"))).otherwise(F.struct(d0.alias("dur"), F.col("cand_no"), F.lit(0).alias("rate")))
    note = F.when(plain, F.when(F.col("cand_no") == 0, "ok").otherwise("compressed")).when(d1.isNull(), F.when(timing.fits(d0, slot), "tts_rate_fail").otherwise("overflow"))
    note = note.otherwise(timing.fit_class(d1, slot, F.col("cand_no") == 0))
    tried = joined.withColumns({"_rate": by_rate, "_dur": dur, "_fits": fits, "_short": shorter, "_note": note})
    last = F.max("cand_no")
    chosen = tried.groupBy("video_id", "idx", "slot_s").agg(
        last.alias("_last"), F.max(F.when(d0.isNotNull(), F.col("cand_no"))).alias("_last_ok"),
        F.min_by(F.struct("cand_no", F.col("_rate").alias("rate"), F.col("_dur").alias("dur"), F.col("_note").alias("note")), F.when(d0.isNotNull() & F.col("_fits"), F.col("cand_no"))).alias("_first"),
        F.max_by(F.struct("cand_no", F.col("_rate").alias("rate"), F.col("_dur").alias("dur"), F.col("_note").alias("note")), F.col("cand_no")).alias("_end"), F.min(F.when(d0.isNotNull(), F.col("_short"))).alias("_best"),
    )
    best = F.struct(F.col("_best.cand_no").alias("cand_no"), F.col("_best.rate").alias("rate"), F.col("_best.dur").alias("dur"), timing.fit_class(F.col("_best.dur"), F.col("slot_s"), F.col("_best.cand_no") == 0).alias("note"))
    pick = F.when(F.col("_first").isNotNull(), F.col("_first")).when(F.col("_last_ok") == F.col("_last"), F.col("_end")).when(F.col("_best").isNotNull(), best)
    out = chosen.withColumn("_p", pick)
    return out.select("video_id", "idx", F.col("_p.cand_no").alias("cand_no"), F.col("_p.rate").alias("rate_pct"), F.col("_p.dur").alias("dur"), F.coalesce("_p.note", F.lit("no_audio")).alias("note"))
