"""Times, durations and fitting, as column expressions. Media time is double seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_to_seconds(c: Column) -> Column:
    """``HH:MM:SS.mmm`` or with a comma, in seconds."""
    part = F.split(F.translate(c, ",", "."), "[:.]")
    at = lambda i: F.get(part, i)
    fraction = F.coalesce(F.concat(F.lit("0."), at(3)).cast("double"), F.lit(0.0))
    return at(0).cast("int") * 3600 + at(1).cast("int") * 60 + at(2).cast("int") + fraction


def _rounded(c: Column, per_second: int) -> Column:
    return F.rint(F.greatest(c, F.lit(0.0)) * per_second).cast("bigint")


def millis(c: Column) -> Column:
    return F.rint(c * 1000).cast("bigint")


def _int(c: Column, per: int, within: int | None = None) -> Column:
    whole = F.floor(c / per).cast("bigint")
    return whole if within is None else whole % within


def seconds_to_ts(c: Column, sep: str = ".") -> Column:
    """``HH:MM:SS.mmm`` of seconds, half to even; negative times count as zero."""
    ms = _rounded(c, 1000)
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", _int(ms, 3_600_000), _int(ms, 60_000, 60), _int(ms, 1000, 60), ms % 1000)


def seconds_to_ass(c: Column) -> Column:
    """``H:MM:SS.cc`` of seconds."""
    cs = _rounded(c, 100)
    return F.format_string("%d:%02d:%02d.%02d", _int(cs, 360_000), _int(cs, 6000, 60), _int(cs, 100, 60), cs % 100)


def slot(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.05), end - start)


def fit_rate(dur: Column, slot: Column, max_rate: int = 30) -> Column:
    """Speed-up in percent that brings dur into slot, with some headroom, between 1 and max_rate; 0 if it fits."""
    need = dur / slot - 1.0
    percent = F.ceil(need * 100 * 1.05).cast("int")
    return F.when((dur <= 0) | (slot <= 0) | (need <= 0), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(max_rate), percent)))


def fits(dur: Column, slot: Column) -> Column:
    return dur <= slot * 1.15


def fit_class(dur: Column, slot: Column, unchanged: Column) -> Column:
    """``ok`` or ``compressed`` if the clip fits its slot, else ``overflow``."""
    return F.when(~fits(dur, slot), "overflow").when(unchanged, "ok").otherwise("compressed")


def is_truncated(out_dur: Column, source_dur: Column, cover_s: float = 0.0) -> Column:
    """The output is clearly shorter than the source, with its cover."""
    return out_dur + 2.0 < (source_dur + cover_s) * 0.98


def narration_is_short(narration_dur: Column, video_dur: Column) -> Column:
    return narration_dur + 1.0 < video_dur * 0.95


def cover_missing(out_dur: Column, source_dur: Column) -> Column:
    """The output is whole, but lacks the second that a cover adds."""
    return ~is_truncated(out_dur, source_dur) & (out_dur + 0.5 < source_dur + 0.9)


def source_is_stale(size: Column, full_size: Column) -> Column:
    return F.coalesce(size < full_size * 0.9, F.lit(False))


def artifact_fresh(size: Column, at: Column, source_at: Column) -> Column:
    """A decoded clip is reusable: large enough and not older than what it was made from."""
    return F.coalesce((size >= 500) & (at >= source_at), F.lit(False))
