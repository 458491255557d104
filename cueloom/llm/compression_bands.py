"""Quality rules from compression: repetitive and incompressible texts fall outside bands set by length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from cueloom.llm.textscan import Slice, shingles, slices

#: (texts of at least so many bytes, lowest and highest allowed ratio of compressed to raw bytes).
#: Under 128 bytes zstandard's frame hides what is incompressible, so there is no upper limit.
DOCUMENT_BANDS = [(0, 0.0, 9.0), (32, 0.45, 9.0), (128, 0.30, 1.05), (512, 0.28, 0.85), (2048, 0.25, 0.75), (8192, 0.20, 0.70), (65536, 0.15, 0.65)]
#: The same for fixed chunks and for the last CHUNK_BYTES of a text that ends with a shorter one; a text fails when more
#: than MAX_BAD_CHUNKS of them do, so one of fewer than ten chunks may have none.
CHUNK_BYTES = 4096
CHUNK_BAND = (0.20, 0.75)
MAX_BAD_CHUNKS = 0.1
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_bytes long, zstd_ratio double, n_chunks long, n_bad_chunks long"
)


def repeat_words(words: np.ndarray, width: int = 5) -> int:
    """How many words stand in a window of width words that occurs twice or more."""
    if len(words) <= width:
        return 0
    windows = shingles(words, width)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(s: Slice) -> np.ndarray:
    """For each row, how many lines with a word equal an earlier line of the row."""
    cuts = np.flatnonzero(s.data == 10)
    starts = np.unique(np.concatenate([s.offsets[:-1], cuts + 1]))
    starts = starts[starts < len(s.data)]
    ends = np.minimum(np.append(starts[1:], len(s.data)), len(s.data))
    has_break = (ends > starts) & (s.data[ends - 1] == 10)
    ends = ends - has_break
    filled = np.searchsorted(s.starts, ends) > np.searchsorted(s.starts, starts)
    starts, ends = starts[filled], ends[filled]
    hashes = s.span_hashes(starts, ends)
    bounds = np.searchsorted(starts, s.offsets)
    return np.array([b - a - len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)


def outside(ratio: float, low: float, high: float) -> bool:
    return ratio < low or ratio > high


def judge(raw: bytes, zstd: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks, those outside their band, and whether the text stays."""
    if not raw:
        return 1.0, 0, 0, True
    ratio = len(zstd.compress(raw)) / len(raw)
    low, high = next((lo, hi) for least, lo, hi in reversed(DOCUMENT_BANDS) if len(raw) >= least)
    chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw) - CHUNK_BYTES + 1, CHUNK_BYTES)]
    if len(raw) > CHUNK_BYTES and len(raw) % CHUNK_BYTES:
        chunks.append(raw[-CHUNK_BYTES:])
    bad = sum(outside(len(zstd.compress(c)) / CHUNK_BYTES, *CHUNK_BAND) for c in chunks)
    return ratio, len(chunks), bad, not outside(ratio, low, high) and bad <= MAX_BAD_CHUNKS * len(chunks)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    for batch in batches:
        ids = batch.column(0)
        for s in slices(batch.column(1)):
            words, n = s.word_hashes(), len(s)
            counts = np.diff(s.bounds)
            repeats = np.array([repeat_words(words[s.bounds[r] : s.bounds[r + 1]]) for r in range(n)], np.int64)
            verdicts = [judge(s.row_bytes(r), zstd) for r in range(n)]
            failed = (counts < 10) | (100 * repeats > 20 * counts)
            kept = ~failed & np.array([v[3] for v in verdicts])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(s.first, n), pa.array(counts.astype(np.int64)), pa.array(s.count_by_row(s.in_word & ((s.data & 0xC0) != 0x80))),
                    pa.array(s.count_by_row(SYMBOLS[s.data])), pa.array(duplicate_lines(s)), pa.array(repeats), pa.array(failed), pa.array(kept),
                    pa.array(np.diff(s.offsets).astype(np.int64)), pa.array([v[0] for v in verdicts], pa.float64()), pa.array([v[1] for v in verdicts], pa.int64()), pa.array([v[2] for v in verdicts], pa.int64()),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )


def quality_rules(docs: DataFrame) -> DataFrame:
    """Judge every whole text by word and line counts and by its zstandard ratios.

    Uses doc_id and text; other columns are ignored. A null or empty text has no words, so it fails the base rule;
    repeated rows are each judged. All chunks of a long text count, up to its end. No shuffle: each row is judged where it is read.
    """
    return docs.select("doc_id", "text").mapInArrow(_judged, SCHEMA)
