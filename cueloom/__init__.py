"""Timed-text analytics on Spark: caption tables keyed by video, as DataFrame-to-DataFrame operators."""
