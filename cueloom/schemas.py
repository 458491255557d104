"""Schemas of the tables that operators exchange. All are keyed by video_id; order keys are explicit columns."""

from __future__ import annotations

CUES = "video_id long, cue_no long, start_s double, end_s double, text string"
SEGMENTS = (
    "video_id long, idx int, start_s double, end_s double, en string, zh string, "
    "rate_pct int, audio string, tts_dur double, fitted boolean, note string"
)
LEDGER = "video_id long, stage string, status string, at timestamp, detail map<string,string>, error string"
REPLIES = "video_id long, batch_no long, body string"

# The stages of a run in order.
STAGES = ["download", "prepare_video", "prepare_cues", "merge", "translate", "tts", "narration", "compose"]
