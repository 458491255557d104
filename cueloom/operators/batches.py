"""Batched text transforms: requests, replies, resume, refill of what is missing, fallback."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.functions import text as T
from cueloom.sinks.documents import append_lines
from cueloom.sources.lines import read_lines

BATCH_SIZE = 100
SMALL_BATCH = 40
DONE_SHARE = 0.95
STAGE_SHARE = 0.98
RETRY_SHARE = 0.05


def assign_batches(lines: DataFrame, size: int = BATCH_SIZE, order: str = "idx") -> DataFrame:
    """Add batch_no and local_no (from 1) of consecutive lines; order is dense from 0 in each video."""
    return lines.withColumns({"batch_no": F.floor(F.col(order) / size).cast("long"), "local_no": (F.col(order) % size + 1).cast("long")})


def build_requests(batched: DataFrame) -> DataFrame:
    """One numbered payload for each batch: (video_id, batch_no, expected, payload)."""
    line = F.concat(F.col("local_no").cast("string"), F.lit(". "), T.drop_fillers(F.col("en")))
    lines = F.array_sort(F.collect_list(F.struct("local_no", line.alias("line"))))
    return batched.groupBy("video_id", "batch_no").agg(F.count(F.lit(1)).alias("expected"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("payload"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(video_id, batch_no, local_no, zh) of replies (video_id, batch_no, expected, body): of repeated numbers the last line wins."""
    body = T.strip_fence(F.col("body"))
    rows = replies.select("video_id", "batch_no", F.explode(T.parse_numbered(body, F.col("expected"))).alias("_r"))
    return rows.groupBy("video_id", "batch_no", F.col("_r.n").alias("local_no")).agg(T.clean_reply(F.max_by("_r.text", "_r.pos")).alias("zh"))


def rekey_batches(parsed: DataFrame, segments: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Replies at their lines: (video_id, idx, batch_no, local_no, zh, en); numbers outside the video are dropped."""
    placed = parsed.withColumn("idx", (F.col("batch_no") * size + F.col("local_no") - 1).cast("long"))
    return placed.join(segments.select("video_id", F.col("idx").cast("long").alias("idx"), "en"), ["video_id", "idx"]).select("video_id", "idx", "batch_no", "local_no", "zh", "en")


def store_only_real(rekeyed: DataFrame) -> DataFrame:
    """Replies that are neither blank nor the source text again."""
    return rekeyed.where(~T.is_blank(F.col("zh")) & ~T.is_untranslated(F.col("zh"), F.col("en"))).withColumn("zh", T.squeeze_ends(F.col("zh")))


def batch_coverage(requests: DataFrame, real: DataFrame) -> DataFrame:
    """Per batch: expected, got, whether it counts as done and whether it should be asked again."""
    got = real.groupBy("video_id", "batch_no").agg(F.count(F.lit(1)).alias("got"))
    both = requests.select("video_id", "batch_no", "expected").join(got, ["video_id", "batch_no"], "left").withColumn("got", F.coalesce("got", F.lit(0)).cast("long"))
    done = (F.col("expected") > 0) & (F.col("got") >= F.floor(F.col("expected") * F.lit(DONE_SHARE)))
    return both.withColumns({"done": done, "retry": (F.col("expected") - F.col("got")) / F.greatest(F.lit(1), F.col("expected")) > RETRY_SHARE})


def missing_lines(segments: DataFrame, real: DataFrame) -> DataFrame:
    return segments.select("video_id", F.col("idx").cast("long").alias("idx"), "en").join(real.select("video_id", "idx"), ["video_id", "idx"], "left_anti")


def merge_refill(real: DataFrame, refill: DataFrame) -> DataFrame:
    """The main result where there is one, else the refill: (video_id, idx, zh)."""
    r = refill.select("video_id", "idx", F.col("zh").alias("_r"))
    return real.select("video_id", "idx", "zh").join(r, ["video_id", "idx"], "full").select("video_id", "idx", F.coalesce("zh", "_r").alias("zh"))


def attach_translation(segments: DataFrame, real: DataFrame) -> DataFrame:
    return segments.drop("zh").join(real.select("video_id", "idx", "zh"), ["video_id", "idx"], "left").withColumn("zh", F.coalesce("zh", F.lit("")))


def fallback_fill(attached: DataFrame) -> DataFrame:
    """Where zh is blank or untranslated, the source text without fillers, flagged is_fallback."""
    real = ~T.is_blank(F.col("zh")) & ~T.is_untranslated(F.col("zh"), F.col("en"))
    return attached.withColumns({"zh": F.when(real, T.squeeze_ends(F.col("zh"))).otherwise(T.drop_fillers(F.col("en"))), "is_fallback": ~real})


def split_failed(batched: DataFrame, failed: DataFrame, size: int = SMALL_BATCH) -> DataFrame:
    """Lines of failed batches of more than size lines, in batches of size: adds sub_no and its own local_no."""
    big = batched.join(failed.select("video_id", "batch_no"), ["video_id", "batch_no"], "left_semi")
    n = F.count(F.lit(1)).over(Window.partitionBy("video_id", "batch_no"))
    big = big.withColumn("_n", n).where(F.col("_n") > size).drop("_n")
    return big.withColumns({"sub_no": F.floor((F.col("local_no") - 1) / size).cast("long"), "sub_local_no": (F.col("local_no") - 1) % size + 1})


def apply_batches(requests: DataFrame, fn: Callable[[str], str], concurrency: int = 2, attempts: int = 5, backoff: float = 0.0, kept: str | None = None) -> DataFrame:
    """Call fn on each payload: (video_id, batch_no, expected, body, error).

    concurrency is the number of tasks that call at once. fn is called again, up to attempts times, when it raises,
    or while more than RETRY_SHARE of the numbers are missing; then its last reply stands. Between calls a task waits
    backoff seconds times the number of calls so far, a quarter of that if a reply came but lacked numbers. An error with a false
    attribute retryable is not tried again. Failures are rows with an error.

    kept names a shared folder where each reply is put, whole, as soon as it is there, under video, batch and a
    hash of the payload: a task that is lost and repeated, or a twin of it, takes what is kept instead of calling, so at most the
    batch in hand is asked for twice. Failures are not kept. A folder serves one round; use another to ask anew.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replies = KeptReplies(kept) if kept is not None else None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                name = (row.video_id, row.batch_no, row.payload)
                body, error = replies.get(*name) if replies else None, None
                if body is None:
                    body, error = asked(fn, row.payload, row.expected, attempts, backoff)
                    if replies and error is None and body is not None:
                        replies.put(*name, body)
                out.append((row.video_id, row.batch_no, row.expected, body, error))
            yield pd.DataFrame(out, columns=["video_id", "batch_no", "expected", "body", "error"])

    return requests.select("video_id", "batch_no", "expected", "payload").repartition(concurrency, "video_id", "batch_no").mapInPandas(run, "video_id long, batch_no long, expected long, body string, error string")


def asked(fn: Callable[[str], str], payload: str, expected: int, attempts: int, backoff: float) -> tuple[str | None, str | None]:
    """(last reply, error of the last call)."""
    body, error = None, None
    for n in range(1, attempts + 1):
        try:
            body, error = fn(payload), None
        except Exception as e:  # noqa: BLE001  whatever the function raises becomes the row's error
            error, wait = str(e), backoff
            if not getattr(e, "retryable", True):
                break
        else:
            wait = backoff / 4
            numbers = {int(x) for x in re.findall(r"(?m)^\s*(\d+)\.\s*\S", body or "")}
            if expected - len(numbers & set(range(1, expected + 1))) <= RETRY_SHARE * expected:
                break
        if n < attempts and wait:
            time.sleep(wait * n)
    return body, error


class KeptReplies:
    """Replies in a folder that tasks share, one file each; a file appears whole by renaming."""

    def __init__(self, folder: str) -> None:
        self.files, self.top = fs.FileSystem.from_uri(folder)

    def _path(self, video_id: int, batch_no: int, payload: str) -> str:
        return f"{self.top}/{video_id}/{batch_no}-{hashlib.sha256(payload.encode()).hexdigest()}"

    def get(self, video_id: int, batch_no: int, payload: str) -> str | None:
        path = self._path(video_id, batch_no, payload)
        if self.files.get_file_info(path).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(path) as f:
            return f.read().decode()

    def put(self, video_id: int, batch_no: int, payload: str, body: str) -> None:
        path = self._path(video_id, batch_no, payload)
        part = f"{path}.{uuid.uuid4().hex}"
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(part) as f:
            f.write(body.encode())
        self.files.move(part, path)


def _asked(batched: DataFrame, fn: Callable[[str], str], concurrency: int) -> tuple[DataFrame, DataFrame]:
    """(real replies (video_id, idx, zh), batches that failed) of numbered lines; replies are written before anything uses them."""
    replies = freeze(apply_batches(build_requests(batched), fn, concurrency), "replies")
    lines = parse_replies(replies.where("body is not null").repartition("video_id")).join(batched.select("video_id", "batch_no", "local_no", "idx", "en"), ["video_id", "batch_no", "local_no"])
    real = freeze(store_only_real(lines.select("video_id", "idx", "batch_no", "local_no", "zh", "en")).select("video_id", "idx", "zh"), "lines")
    return real, replies.where("error is not null").select("video_id", "batch_no")


def stored_lines(segments: DataFrame, store: str, resets: DataFrame | None = None) -> DataFrame:
    """(video_id, idx, zh, refill) of the lines of these segments that earlier runs stored and that are still real.

    A line counts only if it was stored for the same sentence, so segments that were cut anew ask again, and only if it is younger than its
    video's last reset. Lines stored without a sentence's hash count for any.
    """
    lines = read_lines(segments.sparkSession, store, resets)
    known = lines.join(segments.select("video_id", F.col("idx").cast("long").alias("idx"), "en"), ["video_id", "idx"])
    known = known.where(F.col("en_hash").isNull() | (F.col("en_hash") == T.line_hash(F.col("en"))))
    return known.where(~T.is_blank(F.col("zh")) & ~T.is_untranslated(F.col("zh"), F.col("en"))).select("video_id", "idx", "zh", "refill")


def _with_sentence(real: DataFrame, lines: DataFrame) -> DataFrame:
    return real.join(lines.select("video_id", F.col("idx").cast("long").alias("idx"), "en"), ["video_id", "idx"])


def pending_lines(batched: DataFrame, stored: DataFrame, size: int) -> DataFrame:
    """The lines of batches of which fewer than DONE_SHARE came from the main pass."""
    main = stored.where("not refill").select("video_id", F.floor(F.col("idx") / size).cast("long").alias("batch_no"))
    expected = batched.groupBy("video_id", "batch_no").agg(F.count(F.lit(1)).alias("expected"))
    done = batch_coverage(expected, main).where("done").select("video_id", "batch_no")
    return batched.join(done, ["video_id", "batch_no"], "left_anti")


def translate(segments: DataFrame, fn: Callable[[str], str], size: int = BATCH_SIZE, concurrency: int = 2, store: str | None = None, waves: int = 1, resets: DataFrame | None = None) -> DataFrame:
    """Real replies (video_id, idx, zh) of the main pass over all segments.

    Batches that fail altogether are asked again in batches of SMALL_BATCH lines. store is a folder that outlives the
    run: what earlier runs stored there is not asked for again, and what this one learns is added after each of its
    waves of batches, so a run that is killed loses no more than one. Stored refills fill lines that the main pass lacks. resets
    has (video_id, reset_at): what a video's lines were before its last reset is asked for again.
    """
    batched = assign_batches(segments.withColumn("idx", F.col("idx").cast("long")), size)
    if store is not None:
        batched = freeze(pending_lines(batched, stored_lines(segments, store, resets), size).select("video_id", "idx", "en", "batch_no", "local_no"), "pending")
    found = None
    for wave in range(waves):
        now = batched.where(F.pmod(F.xxhash64("video_id", "batch_no"), F.lit(waves)) == wave) if waves > 1 else batched
        if store is not None and now.isEmpty():
            continue
        real, failed = _asked(now, fn, concurrency)
        parts = -(-size // SMALL_BATCH)
        again = split_failed(now, failed).withColumns({"batch_no": F.col("batch_no") * parts + F.col("sub_no"), "local_no": F.col("sub_local_no")})
        if not failed.isEmpty():
            real = real.unionByName(_asked(again.select("video_id", "idx", "en", "batch_no", "local_no"), fn, concurrency)[0])
        if store is not None:
            append_lines(_with_sentence(real, now), store, refill=False)
        found = real if found is None else found.unionByName(real)
    return found if store is None else freeze(stored_lines(segments, store, resets).drop("refill"), "stored")


def refill_rounds(segments: DataFrame, real: DataFrame, fn: Callable[[str], str], size: int = BATCH_SIZE, rounds: int = 2, concurrency: int = 2, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Ask again for missing lines only: (all real replies, summary of rounds: round_no, missing, refilled).

    Missing lines are numbered anew in small batches; rounds end when none is missing or none came back. Each round's
    replies are added to the store, if there is one, where translate() finds them in the next run.
    """
    summary = []
    for turn in range(1, rounds + 1):
        missing = missing_lines(segments, real)
        numbered = freeze(missing.withColumn("line_no", F.row_number().over(Window.partitionBy("video_id").orderBy("idx")) - 1), "missing")
        n = numbered.count()
        if not n:
            break
        found, _ = _asked(assign_batches(numbered, min(size, SMALL_BATCH), "line_no"), fn, concurrency)
        if store is not None:
            append_lines(_with_sentence(found, numbered), store, refill=True)
        got = found.count()
        summary.append((turn, n, got))
        real = merge_refill(real, found)
        if not got:
            break
    return real, segments.sparkSession.createDataFrame(summary, "round_no int, missing long, refilled long")


def translation_coverage(segments: DataFrame) -> DataFrame:
    """Per video: lines, real and untranslated ones, and whether the translation counts as complete."""
    echo = T.is_untranslated(F.col("zh"), F.col("en"))
    out = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(~T.is_blank(F.col("zh")) & ~echo, 1)).alias("real"), F.count(F.when(echo, 1)).alias("untranslated"))
    return out.withColumn("complete", (F.col("real") >= F.greatest(F.lit(1), F.floor(F.col("lines") * F.lit(STAGE_SHARE)))) & (F.col("untranslated") == 0))


def refill_summary(attached: DataFrame, refill: DataFrame) -> DataFrame:
    """Per video: lines the refill gave, lines still missing (to be filled by fallback)."""
    gave = refill.select("video_id", "idx", F.lit(1).alias("_r"))
    real = ~T.is_blank(F.col("zh")) & ~T.is_untranslated(F.col("zh"), F.col("en"))
    return attached.join(gave, ["video_id", "idx"], "left").groupBy("video_id").agg(F.count(F.when(real & F.col("_r").isNotNull(), 1)).alias("refilled"), F.count(F.when(~real, 1)).alias("fallback"))
