"""Caption documents and table writers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import settings
from cueloom.functions import text as T
from cueloom.functions import timing

# Fixed value: what stands before the events of an ASS document.
ASS_HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: 640
PlayResY: 360
WrapStyle: 2
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: ZH,PingFang SC,16,&H0000F0FF,&H000000FF,&H00101010,&H00000000,0,0,0,0,100,100,0,0,1,1.6,0,2,20,20,24,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def _document(rows: DataFrame, line: Column) -> DataFrame:
    """(video_id, body) with a video's lines in order of n."""
    lines = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return rows.groupBy("video_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))


def render_srt(segments: DataFrame, field: str = "zh") -> DataFrame:
    """One SRT document for each video with text: (video_id, body). Blank lines are left out and numbers start at 1."""
    text = T.squeeze_ends(F.col(field))
    order = Window.partitionBy("video_id").orderBy("idx")
    shown = segments.where(~T.is_blank(F.col(field))).withColumn("n", F.row_number().over(order))
    times = F.concat(timing.seconds_to_ts(F.col("start_s"), ","), F.lit(" --> "), timing.seconds_to_ts(F.col("end_s"), ","))
    return _document(shown, F.concat_ws("\n", F.col("n").cast("string"), times, text, F.lit("")))


def render_ass(segments: DataFrame, width: int = 32) -> DataFrame:
    """One ASS document for each video with text: (video_id, body)."""
    text = T.squeeze_ends(T.escape_ass(F.col("zh")))
    shown = segments.where(~T.is_blank(F.col("zh"))).withColumn("n", F.col("idx"))
    line = F.concat(F.lit("Dialogue: 0,"), timing.seconds_to_ass(F.col("start_s")), F.lit(","), timing.seconds_to_ass(F.col("end_s")), F.lit(",ZH,,0,0,0,,"), T.wrap_caption(text, width))
    return _document(shown, line).withColumn("body", F.concat(F.lit(ASS_HEADER), "body", F.lit("\n")))


def write_documents(documents: DataFrame, path: str, buckets: int = 64) -> None:
    """Documents (video_id, body) as Parquet in folders by a bucket of video_id, so their number does not grow with the videos."""
    documents.withColumn("bucket", F.pmod("video_id", F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_files(files: DataFrame, path: str, buckets: int = 64) -> int:
    """Each row of (video_id, name, value) as a file of that name, in UTF-8, in folders by a bucket of video_id; the number of files.

    For millions of small files: tasks write them where they stay, whole, so none is renamed or committed one by one by the
    driver, and a task that is repeated writes the same again. path is in a folder that all tasks share.
    """
    spark = files.sparkSession
    store, top = fs.FileSystem.from_uri(path)
    for k in range(buckets):
        store.create_dir(f"{top}/{k}", recursive=True)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(path)
        for frame in frames:
            for bucket, name, value in zip(frame["bucket"], frame["name"], frame["value"], strict=True):
                with store.open_output_stream(f"{top}/{bucket}/{name}") as f:
                    f.write(value.encode())
            yield pd.DataFrame({"n": [len(frame)]})

    dealt = files.select(F.coalesce(F.pmod("video_id", F.lit(buckets)), F.lit(0)).alias("bucket"), "name", "value")
    with settings(spark, execution__arrow__maxRecordsPerBatch="500"):
        return dealt.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_segments(segments: DataFrame, path: str, buckets: int = 64, fmt: str = "parquet") -> None:
    """Segments as Parquet (or JSON) in folders by a bucket of video_id, in order within files; as many tasks write a folder as its rows need."""
    dealt = segments.withColumn("bucket", F.pmod("video_id", F.lit(buckets))).repartitionByRange("bucket", "video_id", "idx")
    dealt.sortWithinPartitions("bucket", "video_id", "idx").write.mode("overwrite").partitionBy("bucket").format(fmt).save(path)


def write_cues(cues: DataFrame, path: str) -> None:
    cues.repartition("video_id").sortWithinPartitions("video_id", "cue_no").write.mode("overwrite").parquet(path)


def write_ordered(rows: DataFrame, table: str, order: str, buckets: int = 64, key: str = "video_id") -> DataFrame:
    """Rows as a table of the catalog, dealt to buckets by key and sorted by key and order within files; the table.

    What works on each video by itself (windows, groupings and joins on key) reads the table without a shuffle: the plan's
    partitions are the buckets. Rows are dealt to tasks by ranges of bucket, key and order, so a bucket is written by as
    many tasks as its rows need, and a task writes few files.
    """
    bucket = F.pmod(F.hash(key), F.lit(buckets))  # the writer's own rule
    dealt = rows.repartitionByRange(bucket, key, order)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).saveAsTable(table)
    return rows.sparkSession.table(table)


def append_lines(lines: DataFrame, path: str, refill: bool, buckets: int = 64) -> None:
    """Append translated lines (video_id, idx, zh, and en if known) with the time of writing, and whether a refill gave them; read_lines() reads them."""
    rows = lines.select("video_id", F.col("idx").cast("long").alias("idx"), "zh", F.lit(refill).alias("refill"), F.current_timestamp().alias("written_at"), (T.line_hash(F.col("en")) if "en" in lines.columns else F.lit(None).cast("long")).alias("en_hash"))
    rows.withColumn("bucket", F.pmod("video_id", F.lit(buckets)).cast("int")).write.mode("append").partitionBy("bucket").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def append_failed(failed: DataFrame, path: str) -> None:
    """Append url and error, separated by a tab, to the log; read_failed() reads it."""
    failed.select("url", "error").write.mode("append").options(sep="\t", escape='"').csv(path)


def read_failed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("url string, error string").options(sep="\t", escape='"').csv(path)
