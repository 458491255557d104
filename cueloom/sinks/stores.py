"""Stores that outlive a run and only grow until they are compacted: replies of batches, events of the ledger.

Each write adds one folder under a greater number (its generation) and a name of its own, so that any two rows have an
order, whatever clocks say. Files appear whole, and a batch's rows lie in one file: who reads while another writes sees
the old row or the new one, and a write that dies leaves nothing that readers see.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import exists, shuffles_dropped
from cueloom.operators import ledger
from cueloom.schemas import REPLIES

_MARKS = "gen long, writer string, bucket int"


def _generations(spark: SparkSession, path: str) -> list[tuple[int, object]]:
    """(number, folder) of each generation: one entry for each write since the last compaction."""
    if not exists(spark, path):
        return []
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)
    return sorted(((int(s.getPath().getName()[4:]), s.getPath()) for s in listed if s.getPath().getName().startswith("gen=")), key=lambda g: g[0])


def _dealt(rows: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """Rows by ranges of bucket and order; what groups them by all of these finds them where they are."""
    return rows.withColumn("bucket", F.pmod("video_id", F.lit(buckets)).cast("int")).repartitionByRange("bucket", *order)


def _add(dealt: DataFrame, path: str, gen: int, writer: str) -> None:
    marked = dealt.withColumns({"gen": F.lit(gen).cast("long"), "writer": F.lit(writer)})
    with shuffles_dropped(dealt.sparkSession):
        marked.write.mode("append").option("compression", "zstd").partitionBy("gen", "writer", "bucket").parquet(path)


def _stored(spark: SparkSession, path: str, fields: str) -> DataFrame:
    schema = f"{fields}, {_MARKS}"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def _last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


# ---- replies


def write_replies(replies: DataFrame, path: str, buckets: int = 64) -> int:
    """Replies (video_id, batch_no, body) in place of what is stored for these batches; the number of the write.

    Of several rows for one batch in one write the one with the greatest body stays, null last. Of two writes that run
    at once each batch's row is one writer's, the same one for all readers.
    """
    spark = replies.sparkSession
    gen = max((g for g, _ in _generations(spark, path)), default=0) + 1
    rows = replies.select("video_id", F.col("batch_no").cast("long").alias("batch_no"), "body")
    key = ["video_id", "batch_no"]
    _add(_last(_dealt(rows, key, buckets), ["bucket", *key], F.col("body").desc_nulls_last()), path, gen, uuid.uuid4().hex)
    return gen


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, batch_no, body): each batch's last reply; none if nothing is stored yet."""
    stored = _stored(spark, path, REPLIES)
    return _last(stored, ["video_id", "batch_no"], F.col("gen").desc(), F.col("writer").desc()).drop("gen", "writer", "bucket")


def compact_replies(spark: SparkSession, path: str, buckets: int = 64) -> int:
    """Write each batch's last reply once more as one generation, then delete the older ones; the number of folders deleted.

    Readers that start in between see rows twice, with one value; a call that dies leaves the same, and the next one
    clears up. Writes that begin meanwhile have greater numbers, and one that shares the last number is ordered after
    what is merged into it. Readers that began before the deletion may miss their files, and so may a write that began
    before the last stored one ended, so call it when neither is under way. Bodies are read only of the folders that hold a last
    reply, which the keys alone tell.
    """
    old = _generations(spark, path)
    if len(old) < 2:
        return 0
    last, key = old[-1][0], ["video_id", "batch_no"]
    stored = _stored(spark, path, REPLIES).where(F.col("gen") <= last)
    live = stored.groupBy(*key).agg(F.max(F.struct("gen", "writer")).alias("_l")).select("_l.gen", "_l.writer").distinct().collect()
    needed = F.struct("gen", "writer").isin(*[F.struct(F.lit(r["gen"]).cast("long"), F.lit(r["writer"])) for r in live]) if live else F.lit(False)
    merged = _last(_dealt(stored.where(needed), key, buckets), ["bucket", *key], F.col("gen").desc(), F.col("writer").desc())
    before = {f.getPath().toString() for f in _children(spark, old[-1][1])}
    _add(merged, path, last, "!" + uuid.uuid4().hex)
    gone = [folder for gen, folder in old if gen < last] + [f.getPath() for f in _children(spark, old[-1][1]) if f.getPath().toString() in before]
    for folder in gone:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)


def _children(spark: SparkSession, folder: object) -> list:
    return list(folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))


# ---- events of the ledger


def write_events(events: DataFrame, path: str, run: str, buckets: int = 64) -> None:
    """Append events (video_id, stage, status, and error, retryable and detail if known) of one run to the ledger.

    Each gets its video's next numbers in seq, in order of stages and, within one, of ledger.STATUS_ORDER, and the time of
    writing. An event is told by run, video, stage and status: what is there already is not written again, so
    a repeated or resumed write adds only what is missing. A run is written by one job at a time; so is a video.
    """
    spark = events.sparkSession
    more = {"error": "string", "retryable": "boolean", "detail": "map<string,string>"}
    rows = ledger.with_ord(events).where("video_id is not null and ord >= 0 and status is not null")
    rows = rows.select("video_id", "ord", "status", *[(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in more.items()])
    rows = _last(rows, ["video_id", "ord", "status"], F.col("error").desc_nulls_last(), F.col("retryable").desc_nulls_last())
    before = _stored(spark, path, ledger.EVENTS)
    there = before.where(F.col("run") == run).select("video_id", "ord", "status")
    greatest = before.groupBy("video_id").agg(F.max("seq").alias("_most"))
    step = F.array_position(F.array(*map(F.lit, ledger.STATUS_ORDER)), F.col("status"))
    numbered = rows.join(there, ["video_id", "ord", "status"], "left_anti").join(greatest, "video_id", "left")
    seq = F.coalesce("_most", F.lit(0)) + F.row_number().over(Window.partitionBy("video_id").orderBy("ord", step, "status"))
    numbered = numbered.withColumns({"seq": seq.cast("long"), "at": F.current_timestamp(), "run": F.lit(run)}).drop("_most")
    gen = max((g for g, _ in _generations(spark, path)), default=0) + 1
    _add(_dealt(numbered.select(*[f.split(" ")[0] for f in ledger.EVENTS.split(", ")]), ["video_id", "seq"], buckets), path, gen, uuid.uuid4().hex)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger as its operators take it: video_id, ord, seq, status, at, error, retryable, detail, run; empty if nothing is written yet."""
    return _stored(spark, path, ledger.EVENTS).drop("gen", "writer", "bucket")
