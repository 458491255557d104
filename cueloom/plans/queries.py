"""Every registered query of timed-text operators, each with the DuckDB SQL that checks it where SQL can express it.

All read whole tables. Times are compared in milliseconds, lists as joined strings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import delete, freeze, settings, shared_root, shuffles_dropped
from cueloom.functions import splitting, timing
from cueloom.functions import text as T
from cueloom.operators import batches, cues, fit, ledger, quality, segments, timeline
from cueloom.plans import fixtures as X
from cueloom.plans import sql as D
from cueloom.schemas import STAGES
from cueloom.sinks import documents as K
from cueloom.sinks import stores
from cueloom.sources import captions, tables
from cueloom.sources.lines import read_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


def _ms(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select("video_id", *more, timing.millis(F.col("start_s")).alias("start_ms"), timing.millis(F.col("end_s")).alias("end_ms"))


_MS = f"{D.millis('start_s')} AS start_ms, {D.millis('end_s')} AS end_ms"


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return X.derived(spark, sf, "segments")


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    return X.derived(spark, sf, "outputs")


def _new_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_root(spark)}/cueloom/{uuid.uuid4().hex}/{name}"


# ---- functions of one value: each applied to every cue or segment

_KEYS = "video_id, cue_no"


def _scalar(name: str, column: Callable[[], Column], sql: str, raw: str = "text") -> None:
    """A query of one column over all cues; raw is SQL, alike in both engines, for its input x."""
    QUERIES[name] = lambda spark, sf: X.cues(spark, sf).select("video_id", "cue_no", "start_s", "end_s", F.expr(raw).alias("x")).select("video_id", "cue_no", column().alias("value"))
    ORACLE[name] = f"{X.duck()}, raw AS (SELECT video_id, cue_no, start_s, end_s, {raw} AS x FROM cues) SELECT {_KEYS}, {sql} AS value FROM raw"


_x = lambda: F.col("x")
_flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
_WHOLE_MS = "CAST(round(end_s*1000e0) AS BIGINT)"
_PART = "lpad(CAST(CAST(floor({0}/{1}e0) AS BIGINT)%{2} AS STRING),{3},'0')"
_STAMP = "concat(" + ", ".join([_PART.format(_WHOLE_MS, 3_600_000, 100, 2), "':'", _PART.format(_WHOLE_MS, 60_000, 60, 2), "':'", _PART.format(_WHOLE_MS, 1000, 60, 2), "CASE WHEN cue_no%2=0 THEN '.' ELSE ',' END", _PART.format(_WHOLE_MS, 1, 1000, 3)]) + ")"
_scalar("ts_to_seconds", lambda: timing.millis(timing.ts_to_seconds(_x())), D.millis("CAST(substr(x,1,2) AS INT)*3600+CAST(substr(x,4,2) AS INT)*60+CAST(substr(x,7,2) AS INT)+CAST('0.'||substr(x,10) AS DOUBLE)"), _STAMP)
_scalar("seconds_to_ts", lambda: F.concat(timing.seconds_to_ts(F.col("start_s")), timing.seconds_to_ts(F.col("end_s") - 5, ",")), f"concat({D.stamp('start_s', '.')}, {D.stamp('(end_s-5)', ',')})")
_scalar("seconds_to_ass", lambda: timing.seconds_to_ass(F.col("start_s")), D.ass_stamp("start_s"))
_scalar("clean_caption_text", lambda: T.clean_caption_text(_x()), D.clean("x"), "concat('<c>', text, '</c> &amp;lt; &nbsp; <00:00:01.000><b>', text, '</b>')")
_scalar("normalize_cue_text", lambda: T.normalize_cue_text(_x()), D.normalize("x"), "concat(' , um ', text, ' , , uhh, umm um ', text, ' ,')")
_scalar("drop_fillers", lambda: T.drop_fillers(_x()), D.drop_fillers("x"), "concat('Ok, you know ', text, ' i mean um uh okay ', text)")
_scalar("payload_line_filter", lambda: _flag(captions.is_shown(T.squeeze_ends(_x()), True)), r"CAST(trim(x)<>'' AND NOT regexp_matches(x,'^\s*[0-9]+\s*$') AND NOT starts_with(trim(x),'NOTE') AND NOT regexp_matches(trim(x),'(?i)^(align|position|size|line|vertical):.*$') AS INT)", "CASE cue_no%6 WHEN 0 THEN CAST(cue_no AS STRING) WHEN 1 THEN concat('NOTE ',text) WHEN 2 THEN concat('Align:',text) WHEN 3 THEN ' ' ELSE text END")
_scalar("ends_sentence", lambda: _flag(T.ends_sentence(_x())), f"CAST({D.ends('x')} AS INT)", "concat(text, CASE cue_no%3 WHEN 0 THEN '.\")' WHEN 1 THEN '' ELSE '! ' END)")
_scalar("dangling_end", lambda: _flag(T.dangling_end(_x())), f"CAST({D.dangling('x')} AS INT)", "concat(text, CASE cue_no%4 WHEN 0 THEN ' They''re, ' WHEN 1 THEN '' WHEN 2 THEN ' the' ELSE '-' END)")
_scalar("starts_continuation", lambda: _flag(T.starts_continuation(_x())), f"CAST({D.continuation('x')} AS INT)", "concat('  ', text)")
_scalar("mid_sentence_cut", lambda: _flag(T.mid_sentence_cut(F.split(_x(), r"\|")[0], F.split(_x(), r"\|")[1])), f"CAST({D.mid_cut('split_part(x, ' + D.q('|') + ', 1)', 'split_part(x, ' + D.q('|') + ', 2)')} AS INT)", "concat(replace(text,'|',' '), CASE cue_no%3 WHEN 0 THEN ' to' ELSE '' END, '|', CASE cue_no%4 WHEN 0 THEN 'lucky.' WHEN 1 THEN 'went on' WHEN 2 THEN '' ELSE replace(text,'|',' ') END)")
_scalar("join_text", lambda: T.join_text(_x(), F.lit("  end\n of ")), D.squeeze("concat_ws(' ', x, '  end\n of ')"))
_scalar("escape_ass", lambda: T.escape_ass(_x()), "replace(replace(replace(x, chr(10), ' '), '{', '('), '}', ')')", "concat('{', text, '}', chr(10), '{b}')")
_scalar("clean_reply", lambda: T.clean_reply(_x()), D.clean_reply("x"), "concat('，好吧，', text, ',  嗯，', text, ', ')")
_scalar("wrap_caption", lambda: T.wrap_caption(_x()), D.wrap("x"), "concat(text, '，', text, '。', text, text, text, text)")
_scalar("narration_is_short", lambda: _flag(timing.narration_is_short(F.col("start_s"), F.col("end_s"))), "CAST(start_s+1e0 < end_s*95e-2 AS INT)")


@register("min_duration", f"{X.duck()} SELECT video_id, cue_no, {_MS} FROM cues WHERE end_s-start_s >= 5e-2")
def min_duration(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(cues.min_duration(X.cues(spark, sf)), "cue_no")


@register("clip_window", f"{X.duck()} SELECT video_id, cue_no, {D.millis('greatest(start_s,5e0)')} AS start_ms, {D.millis('least(end_s,605e-1)')} AS end_ms FROM cues WHERE end_s>5 AND start_s<605e-1")
def clip_window(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(cues.clip_window(X.cues(spark, sf), 60.5, 5.0), "cue_no")


@register("overlap_filter", f"{X.duck()} SELECT video_id, cue_no, {_MS} FROM cues WHERE end_s>5 AND start_s<605e-1")
def overlap_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(cues.overlap_filter(X.cues(spark, sf), 60.5, 5.0), "cue_no")


@register("is_untranslated", f"{X.duck('segments')} SELECT video_id, idx, CAST({D.untranslated('zh', 'en')} AS INT) AS value FROM segments")
def is_untranslated(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("video_id", "idx", _flag(T.is_untranslated(F.col("zh"), F.col("en"))).alias("value"))


_SLOTS = "slots AS (SELECT video_id, cue_no AS idx, greatest(5e-2, end_s-start_s) + CASE WHEN nxt>end_s THEN least(35e-2, nxt-end_s) ELSE 0e0 END AS slot_s FROM (SELECT *, lead(start_s) OVER (PARTITION BY video_id ORDER BY cue_no) AS nxt FROM cues))"


def _trials_with_slots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    slots = segments.slot_with_lead(X.cues(spark, sf).withColumnRenamed("cue_no", "idx"))
    return X.derived(spark, sf, "trials"), slots


@register("fit_rate", f"{X.duck('trials')}, {_SLOTS} SELECT video_id, idx, cand_no, fast, {D.rate('dur', 'slot_s')} AS rate_pct FROM trials JOIN slots USING (video_id, idx)")
def fit_rate(spark: SparkSession, sf: str) -> DataFrame:
    trials, slots = _trials_with_slots(spark, sf)
    return trials.join(slots.select("video_id", "idx", "slot_s"), ["video_id", "idx"]).select("video_id", "idx", "cand_no", "fast", timing.fit_rate(F.col("dur"), F.col("slot_s")).alias("rate_pct"))


@register("fit_class", f"{X.duck('trials')}, {_SLOTS} SELECT video_id, idx, cand_no, fast, CASE WHEN dur > slot_s*115e-2 THEN 'overflow' WHEN cand_no=0 THEN 'ok' ELSE 'compressed' END AS note FROM trials JOIN slots USING (video_id, idx)")
def fit_class(spark: SparkSession, sf: str) -> DataFrame:
    trials, slots = _trials_with_slots(spark, sf)
    return trials.join(slots.select("video_id", "idx", "slot_s"), ["video_id", "idx"]).select("video_id", "idx", "cand_no", "fast", timing.fit_class(F.col("dur"), F.col("slot_s"), F.col("cand_no") == 0).alias("note"))


_BOTH = "b AS (SELECT o.video_id, o.dur AS od, s.dur AS sd, s.size_bytes AS ss, f.size_bytes AS fs FROM outputs o JOIN outputs s ON s.video_id=o.video_id AND s.name='source.mp4' LEFT JOIN outputs f ON f.video_id=o.video_id AND f.name='source_full.mp4' WHERE o.name='out.mp4')"


def _out_and_source(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda name: F.max(F.when(F.col("name") == name, F.struct("dur", "size_bytes")))
    per = _outputs(spark, sf).groupBy("video_id").agg(pick("out.mp4").alias("o"), pick("source.mp4").alias("s"), pick("source_full.mp4").alias("f"))
    return per.where("o is not null and s is not null")


@register("is_truncated", f"{X.duck('outputs')}, {_BOTH} SELECT video_id, CAST(od+2e0 < (sd+1e0)*98e-2 AS INT) AS value FROM b")
def is_truncated(spark: SparkSession, sf: str) -> DataFrame:
    return _out_and_source(spark, sf).select("video_id", _flag(timing.is_truncated(F.col("o.dur"), F.col("s.dur"), 1.0)).alias("value"))


@register("cover_missing", f"{X.duck('outputs')}, {_BOTH} SELECT video_id, CAST(od+2e0 >= sd*98e-2 AND od+5e-1 < sd+9e-1 AS INT) AS value FROM b")
def cover_missing(spark: SparkSession, sf: str) -> DataFrame:
    return _out_and_source(spark, sf).select("video_id", _flag(timing.cover_missing(F.col("o.dur"), F.col("s.dur"))).alias("value"))


@register("source_is_stale", f"{X.duck('outputs')}, {_BOTH} SELECT video_id, CAST(coalesce(ss < fs*9e-1, false) AS INT) AS value FROM b")
def source_is_stale(spark: SparkSession, sf: str) -> DataFrame:
    return _out_and_source(spark, sf).select("video_id", _flag(timing.source_is_stale(F.col("s.size_bytes"), F.col("f.size_bytes"))).alias("value"))


@register("artifact_fresh", f"{X.duck('manifest')} SELECT video_id, name, CAST(size_bytes>=500 AND size_bytes%97 >= video_id%97 AS INT) AS value FROM manifest")
def artifact_fresh(spark: SparkSession, sf: str) -> DataFrame:
    return X.derived(spark, sf, "manifest").select("video_id", "name", _flag(timing.artifact_fresh(F.col("size_bytes"), F.col("size_bytes") % 97, F.col("video_id") % 97)).alias("value"))


@register("english_only", f"{X.duck('segments')} SELECT video_id, CAST(idx AS INT) AS idx, {_MS}, en, '' AS zh, 0 AS rate_pct, '' AS audio, '' AS note FROM segments")
def english_only(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(segments.english_only(_segments(spark, sf)), "idx", "en", "zh", "rate_pct", "audio", "note")


# ---- sources

_LIST = "['source.en.vtt','source.en.srt','source.vtt','source.srt']"


@register("pick_caption_file", f"{X.duck('outputs')} SELECT video_id, arg_min(name, list_position({_LIST}, name)) AS name FROM outputs WHERE list_contains({_LIST}, name) GROUP BY 1")
def pick_caption_file(spark: SparkSession, sf: str) -> DataFrame:
    return captions.pick_caption_file(_outputs(spark, sf))


def _caption_files(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    rows = X.cues(spark, sf).select("video_id", F.col("cue_no").alias("idx"), "start_s", "end_s", F.col("text").alias("en"))
    if kind == "srt":
        return K.render_srt(rows, "en").select("video_id", F.lit("source.srt").alias("path"), F.col("body").alias("value"))
    times = F.concat(timing.seconds_to_ts(F.col("start_s")), F.lit(" --> "), timing.seconds_to_ts(F.col("end_s")), F.lit(" align:start"))
    cue = F.concat_ws("\n", times, F.lit("first line"), F.lit("line:90%"), F.col("en"), F.lit(""))
    blocks = F.array_sort(F.collect_list(F.struct("idx", cue.alias("cue"))))
    return rows.groupBy("video_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(blocks, lambda b: b["cue"]), "\n")).alias("value")).withColumn("path", F.lit("source.en.vtt"))


def _numbered(df: DataFrame) -> DataFrame:
    return _ms(segments.renumber(df, ["cue_no"], "n"), "n", "text")


_VISIBLE = f"SELECT *, {D.clean('text')} AS shown FROM cues WHERE {D.squeeze('text')}<>''"


@register("parse_srt", rf"{X.duck()}, v AS ({_VISIBLE}) SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY cue_no)-1 AS INT) AS n, {_MS}, shown AS text FROM v WHERE shown<>'' AND NOT regexp_matches(trim(text),'^[0-9]+$') AND end_s-start_s>=5e-2")
def parse_srt(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(captions.parse_srt(_caption_files(spark, sf, "srt")))


@register("parse_vtt", rf"{X.duck()}, v AS (SELECT *, {D.clean('text')} AS shown FROM cues WHERE end_s-start_s>=5e-2) SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY cue_no)-1 AS INT) AS n, {_MS}, CASE WHEN shown='' OR regexp_matches(trim(text),'^[0-9]+$') OR starts_with(trim(text),'NOTE') OR regexp_matches(trim(text),'(?i)^(align|position|size|line|vertical):') THEN 'first line' ELSE shown END AS text FROM v")
def parse_vtt(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(captions.parse_vtt(_caption_files(spark, sf, "vtt")))


_LOADED = rf"""v AS ({_VISIBLE}), numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY cue_no)-1 AS k FROM v),
srt AS (SELECT video_id, k AS cue_no, {_MS}, shown AS text FROM numbered WHERE shown<>'' AND NOT regexp_matches(trim(text),'^[0-9]+$') AND end_s-start_s>=5e-2),
last_line AS (SELECT video_id, cue_no, start_s, end_s, CASE WHEN {D.clean('text')}='' OR regexp_matches(trim(text),'^[0-9]+$') OR starts_with(trim(text),'NOTE') OR regexp_matches(trim(text),'(?i)^(align|position|size|line|vertical):') THEN 'first line' ELSE {D.clean('text')} END AS text FROM cues WHERE end_s-start_s>=5e-2),
{D.collapsed('last_line')}, derolled AS (SELECT video_id, n AS cue_no, c.s AS start_s, c.e AS end_s, c.t AS text FROM collapsed), {D.deltas('derolled')}"""


@register("load_cues", f"{X.duck()}, {_LOADED} SELECT * FROM srt UNION ALL SELECT -video_id-1 AS video_id, n AS cue_no, {D.millis('c.s')} AS start_ms, {D.millis('c.e')} AS end_ms, c.t AS text FROM deltas")
def load_cues(spark: SparkSession, sf: str) -> DataFrame:
    files = _caption_files(spark, sf, "srt").unionByName(_caption_files(spark, sf, "vtt").withColumn("video_id", -F.col("video_id") - 1))
    return _ms(captions.load_cues(files), "cue_no", "text")


#: Readers of JSON parse each file whole.
ROWS_PER_FILE = 40_000


@register("read_segments", f"{X.duck('segments')} SELECT video_id, CAST(idx AS INT) AS idx, {_MS}, en, zh, note FROM segments")
def read_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = _segments(spark, sf).select("video_id", F.to_json(F.struct("video_id", "idx", "start_s", "end_s", "en", "zh", "note")).alias("row"))
    path = _new_path(spark, "segments_json")
    with shuffles_dropped(spark):
        rows.select("row").write.option("maxRecordsPerFile", ROWS_PER_FILE).text(path, compression="gzip")
    return _ms(tables.read_segments(spark, path), "idx", "en", "zh", "note")


#: Of so many videos files are there at once.
WAVE = 50_000


def _in_waves(spark: SparkSession, sf: str, texts: DataFrame, use: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What use(texts of some videos, a new folder) reads from the files that it writes there, for all videos of texts.

    The files of a wave are deleted before the next wave's are written, so neither disk nor the driver, which lists them,
    ever holds all. Waves follow the shuffle that texts come from, so a task writes to few of them.
    """
    waves = max(1, -(-spark.read.parquet(f"{sf}/documents.parquet").count() // WAVE))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = (F.pmod(F.hash("video_id"), F.lit(n)) + F.pmod(F.xxhash64("video_id"), F.lit(1000)) / 1000) / n
    path = _new_path(spark, "waves")
    with shuffles_dropped(spark):
        texts.withColumn("wave", F.floor(place * waves).cast("int")).write.option("compression", "zstd").partitionBy("wave").parquet(path)
    kept, found = spark.read.schema(", ".join(f"{c} {t}" for c, t in [*texts.dtypes, ("wave", "int")])).parquet(path), []
    for wave in range(waves):
        files = _new_path(spark, "files")
        with settings(spark, files__openCostInBytes=str(1 << 14), sources__parallelPartitionDiscovery__parallelism="64"):
            found.append(freeze(use(kept.where(F.col("wave") == wave).drop("wave"), files), "found"))
        delete(spark, files)
    delete(spark, path)
    return reduce(DataFrame.unionByName, found)


_FILE = r"/(-?\d+)\.([^/]+)$"


def _json_texts(rows: DataFrame) -> DataFrame:
    """The text of one JSON file for each video, of (video_id, a): indented, on one line, or a row to a line; every seventeenth is cut short."""
    kind = F.pmod("video_id", F.lit(3))
    text = F.when(kind == 0, F.to_json("a", {"pretty": "true"})).when(kind == 1, F.to_json("a")).otherwise(F.array_join(F.transform("a", lambda x: F.to_json(x)), "\n"))
    cut = F.when(F.pmod("video_id", F.lit(17)) == 3, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    return rows.select("video_id", F.concat("video_id", F.lit(".json")).alias("name"), cut.alias("value"))


def _of_json(read: Callable[[str], DataFrame]) -> Callable[[DataFrame, str], DataFrame]:
    def use(texts: DataFrame, path: str) -> DataFrame:
        K.write_files(texts, path)
        return read(path)

    return use


def _segment_texts(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct("idx", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "en", "zh", "note", F.lit("unknown").alias("extra"))
    return _json_texts(_segments(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("a")))


@register("read_segment_files", f"{X.duck('segments')} SELECT video_id, CAST(idx AS INT) AS idx, {_MS}, en, zh, note FROM segments WHERE video_id%17<>3")
def read_segment_files(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda path: _ms(tables.read_segments(spark, path, _FILE, strict=False), "idx", "en", "zh", "note")
    return _in_waves(spark, sf, _segment_texts(spark, sf), _of_json(read))


@register("unreadable_files", f"{X.duck()} SELECT DISTINCT video_id FROM cues WHERE video_id%17=3")
def unreadable_files(spark: SparkSession, sf: str) -> DataFrame:
    read = lambda path: tables.unreadable_files(spark, path).select(F.regexp_extract("path", _FILE, 1).cast("long").alias("video_id"))
    return _in_waves(spark, sf, _segment_texts(spark, sf), _of_json(read))


@register("read_cue_files", f"{X.duck()} SELECT video_id, cue_no, {_MS}, text FROM cues WHERE video_id%17<>3")
def read_cue_files(spark: SparkSession, sf: str) -> DataFrame:
    row = F.struct("cue_no", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text")
    rows = X.cues(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(row)).alias("a"))
    nameless = rows.withColumn("a", F.transform("a", lambda x: x.dropFields("cue_no")))
    read = lambda path: _ms(tables.read_cues(spark, path, _FILE, strict=False), "cue_no", "text")
    return _in_waves(spark, sf, _json_texts(nameless), _of_json(read))


@register("read_url_list", f"WITH l AS ({X.DUCK_URL_LINES}), u AS (SELECT line_no, trim(split_part(trim(line), ' #', 1)) AS url FROM l WHERE trim(line)<>'' AND NOT starts_with(trim(line),'#')) SELECT url, min(line_no) AS line_no FROM u WHERE url<>'' GROUP BY 1")
def read_url_list(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_url_list(X.url_lines(spark, sf))


@register("dedupe_first", f"WITH l AS ({X.DUCK_URL_LINES}) SELECT line, min(line_no) AS line_no FROM l GROUP BY 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return tables.dedupe_first(X.url_lines(spark, sf), "line", "line_no")


@register("file_manifest", f"{X.duck('manifest', 'outputs')}, f AS (SELECT video_id, 'audio' AS name, size_bytes FROM manifest UNION ALL SELECT video_id, name, size_bytes FROM outputs) SELECT video_id, name, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM f GROUP BY 1,2")
def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    audio = X.derived(spark, sf, "manifest").select("video_id", F.concat(F.lit("audio/"), "name").alias("rel_path"), "size_bytes")
    return tables.folder_sizes(audio.unionByName(_outputs(spark, sf).select("video_id", F.col("name").alias("rel_path"), "size_bytes")))


#: Files of each video: (name, whether a video has it). All hold a video's cues, one to a line.
_FILES = [("source.en.vtt", "video_id%4=0"), ("source.srt", "video_id%4 IN (0,1)"), ("source.vtt", "video_id%4=2"), ("narration.wav", "true")]
_LISTED = "listed AS (" + " UNION ALL ".join(f"SELECT video_id, '{name}' AS name, CAST(sum(strlen(coalesce(text,''))+1) AS BIGINT) AS size_bytes FROM cues WHERE {has} GROUP BY 1" for name, has in _FILES) + ")"


def _listing(spark: SparkSession, sf: str, parts: list[tuple[str, str]]) -> DataFrame:
    """The files of these parts, (name, condition), written one part after the other, then listed by the scan."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("cue_no", "text"))), lambda c: F.concat(F.coalesce(c["text"], F.lit("")), F.lit("\n")))
    texts = X.cues(spark, sf).groupBy("video_id").agg(F.array_join(lines, "").alias("value"))

    def use(some: DataFrame, path: str) -> DataFrame:
        for name, has in parts:
            K.write_files(some.where(has).withColumn("name", F.concat("video_id", F.lit(f".{name}"))), path)
        return tables.list_files(spark, path, _FILE).withColumn("video_id", F.col("video_id").cast("long"))

    return _in_waves(spark, sf, texts, use)


@register("file_listing", f"{X.duck()}, {_LISTED} SELECT * FROM listed")
def file_listing(spark: SparkSession, sf: str) -> DataFrame:
    return tables.folder_sizes(_listing(spark, sf, _FILES))


@register("captions_of_listing", f"{X.duck()}, {_LISTED} SELECT video_id, arg_min(name, list_position({_LIST}, name)) FILTER (list_contains({_LIST}, name)) AS name FROM listed GROUP BY 1")
def captions_of_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The caption file of each video in a listing; without a name, the videos to report."""
    files = tables.folder_sizes(_listing(spark, sf, _FILES))
    return captions.pick_caption_file(files).unionByName(captions.without_captions(files), allowMissingColumns=True)


@register("fresh_artifacts", f"{X.duck()}, {_LISTED} SELECT video_id, CAST(size_bytes>=500 AND video_id%3<>0 AND video_id%4 IN (0,1) AS INT) AS fresh FROM listed WHERE name='narration.wav'")
def fresh_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Every third video's narration is written before its captions, the others after."""
    parts = [("narration.wav", "video_id%3=0"), ("source.srt", "video_id%4 IN (0,1)"), ("narration.wav", "video_id%3<>0")]
    return tables.fresh_artifacts(_listing(spark, sf, parts), "source.srt", "narration.wav").select("video_id", _flag(F.col("fresh")).alias("fresh"))


# ---- replies

_PARSED = rf"""lines AS (SELECT video_id, batch_no, expected, unnest(string_split(body, chr(10))) AS line, unnest(generate_series(1, len(string_split(body, chr(10))))) AS pos FROM replies),
nums AS (SELECT *, TRY_CAST(regexp_extract(line, '^\s*(\d+)\.\s*(.*?)\s*$', 1) AS BIGINT) AS local_no, trim(regexp_replace(regexp_extract(line, '^\s*(\d+)\.\s*(.*?)\s*$', 2), '^["''“”]+|["''“”]+$', '', 'g')) AS raw FROM lines WHERE regexp_matches(line, '^\s*\d+\.\s*\S')),
parsed AS (SELECT video_id, batch_no, local_no, {D.clean_reply("arg_max(raw, pos)")} AS zh FROM nums WHERE local_no BETWEEN 1 AND expected AND raw<>'' GROUP BY 1,2,3),
rekeyed AS (SELECT p.video_id, p.batch_no*100+p.local_no-1 AS idx, p.batch_no, p.local_no, p.zh, c.text AS en FROM parsed p JOIN cues c ON c.video_id=p.video_id AND c.cue_no=p.batch_no*100+p.local_no-1),
stored AS (SELECT video_id, idx, batch_no, local_no, trim(zh) AS zh, en FROM rekeyed WHERE {D.real("zh", "en")}),
covered AS (SELECT r.video_id, r.batch_no, r.expected, coalesce(g.got, 0) AS got FROM replies r LEFT JOIN (SELECT video_id, batch_no, count(*) AS got FROM stored GROUP BY 1,2) g USING (video_id, batch_no))"""
_REPLIES = X.duck("replies") + ", " + _PARSED


def _lines_of(spark: SparkSession, sf: str) -> DataFrame:
    return X.cues(spark, sf).select("video_id", F.col("cue_no").alias("idx"), "start_s", "end_s", F.col("text").alias("en"))


def _real(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    replies, lines = X.derived(spark, sf, "replies"), _lines_of(spark, sf)
    return replies, lines, batches.store_only_real(batches.rekey_batches(batches.parse_replies(replies), lines))


@register("parse_numbered", f"{_REPLIES} SELECT * FROM parsed")
def parse_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return batches.parse_replies(X.derived(spark, sf, "replies"))


@register("rekey_batches", f"{_REPLIES} SELECT video_id, idx, batch_no, local_no, zh FROM rekeyed")
def rekey_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches.rekey_batches(batches.parse_replies(X.derived(spark, sf, "replies")), _lines_of(spark, sf)).drop("en")


@register("store_only_real", f"{_REPLIES} SELECT video_id, idx, zh FROM stored")
def store_only_real(spark: SparkSession, sf: str) -> DataFrame:
    return _real(spark, sf)[2].select("video_id", "idx", "zh")


@register("read_batches", f"{_REPLIES} SELECT video_id, batch_no, expected, got AS ok, CAST(expected>0 AND got >= floor(expected*95e-2) AS INT) AS done FROM covered")
def read_batches(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_batches(X.derived(spark, sf, "replies"), _lines_of(spark, sf)).withColumn("done", F.col("done").cast("int"))


@register("batch_coverage", f"{_REPLIES} SELECT video_id, batch_no, expected, got, CAST((expected-got)/greatest(1,expected) > 5e-2 AS INT) AS retry FROM covered")
def batch_coverage(spark: SparkSession, sf: str) -> DataFrame:
    replies, _, real = _real(spark, sf)
    return batches.batch_coverage(replies, real).select("video_id", "batch_no", "expected", "got", F.col("retry").cast("int").alias("retry"))


@register("missing_lines", f"{_REPLIES} SELECT video_id, cue_no AS idx, text AS en FROM cues c WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.video_id=c.video_id AND s.idx=c.cue_no)")
def missing_lines(spark: SparkSession, sf: str) -> DataFrame:
    _, lines, real = _real(spark, sf)
    return batches.missing_lines(lines, real)


_REFILL = "refill AS (SELECT video_id, cue_no AS idx, concat('补', text) AS zh FROM cues WHERE (cue_no+video_id)%2=0)"


def _refill(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_of(spark, sf).where("(idx+video_id)%2=0").select("video_id", "idx", F.concat(F.lit("补"), "en").alias("zh"))


@register("merge_refill", f"{_REPLIES}, {_REFILL} SELECT coalesce(s.video_id, r.video_id) AS video_id, coalesce(s.idx, r.idx) AS idx, coalesce(s.zh, r.zh) AS zh FROM stored s FULL JOIN refill r ON s.video_id=r.video_id AND s.idx=r.idx")
def merge_refill(spark: SparkSession, sf: str) -> DataFrame:
    return batches.merge_refill(_real(spark, sf)[2], _refill(spark, sf))


@register("refill_summary", f"{_REPLIES}, {_REFILL}, m AS (SELECT c.video_id, c.cue_no AS idx, c.text AS en, coalesce(s.zh, r.zh, '') AS zh, r.idx AS ridx FROM cues c LEFT JOIN stored s ON s.video_id=c.video_id AND s.idx=c.cue_no LEFT JOIN refill r ON r.video_id=c.video_id AND r.idx=c.cue_no) SELECT video_id, count(*) FILTER ({D.real('zh', 'en')} AND ridx IS NOT NULL) AS refilled, count(*) FILTER (NOT {D.real('zh', 'en')}) AS fallback FROM m GROUP BY 1")
def refill_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, lines, real = _real(spark, sf)
    refill = _refill(spark, sf)
    return batches.refill_summary(batches.attach_translation(lines.withColumn("zh", F.lit("")), batches.merge_refill(real, refill)), refill)


@register("attach_translation", f"{_REPLIES} SELECT c.video_id, c.cue_no AS idx, coalesce(s.zh,'') AS zh FROM cues c LEFT JOIN stored s ON s.video_id=c.video_id AND s.idx=c.cue_no")
def attach_translation(spark: SparkSession, sf: str) -> DataFrame:
    _, lines, real = _real(spark, sf)
    return batches.attach_translation(lines, real).select("video_id", "idx", "zh")


@register("fallback_fill", f"{X.duck('segments')} SELECT video_id, idx, CASE WHEN {D.real('zh', 'en')} THEN trim(zh) ELSE {D.drop_fillers('en')} END AS zh, CAST(NOT {D.real('zh', 'en')} AS INT) AS is_fallback FROM segments")
def fallback_fill(spark: SparkSession, sf: str) -> DataFrame:
    return batches.fallback_fill(_segments(spark, sf)).select("video_id", "idx", "zh", F.col("is_fallback").cast("int").alias("is_fallback"))


@register("assign_batches", f"{X.duck()} SELECT video_id, cue_no AS idx, CAST(floor(cue_no/100) AS BIGINT) AS batch_no, cue_no%100+1 AS local_no FROM cues")
def assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches.assign_batches(_lines_of(spark, sf)).select("video_id", "idx", "batch_no", "local_no")


@register("build_requests", f"{X.duck()} SELECT video_id, CAST(floor(cue_no/100) AS BIGINT) AS batch_no, count(*) AS expected, string_agg(concat(CAST(cue_no%100+1 AS VARCHAR), '. ', {D.drop_fillers('text')}), chr(10) ORDER BY cue_no) AS payload FROM cues GROUP BY 1,2")
def build_requests(spark: SparkSession, sf: str) -> DataFrame:
    return batches.build_requests(batches.assign_batches(_lines_of(spark, sf)))


_AGES = "['2024-03-01 00:00:00','2024-03-02 00:00:00','2024-03-03 00:00:00']"


@register("lines_since_reset", f"""{X.duck()}, st AS (SELECT video_id, cue_no AS idx, k, (cue_no+k)%2=0 AS refill, ({_AGES})[(cue_no*2+video_id+k)%3+1]::TIMESTAMP AS written_at, concat('译', CAST(k AS VARCHAR), text) AS zh FROM cues CROSS JOIN (VALUES (0),(1)) v(k)),
resets AS (SELECT DISTINCT video_id, CASE WHEN video_id%4=0 THEN '2024-03-02 00:00:00'::TIMESTAMP END AS reset_at FROM cues WHERE video_id%2=0),
fresh AS (SELECT st.* FROM st LEFT JOIN resets r ON r.video_id=st.video_id WHERE r.reset_at IS NULL OR written_at>reset_at)
SELECT video_id, idx, zh, CAST(refill AS INT) AS refill FROM fresh QUALIFY row_number() OVER (PARTITION BY video_id, idx ORDER BY refill, written_at DESC, zh)=1""")
def lines_since_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Stored lines of three ages; some videos were sent back to translate between them, others to a later stage or never."""
    path = _new_path(spark, "lines")
    stored = spark.sql(f"SELECT video_id, cue_no AS idx, concat('译', CAST(k AS STRING), text) AS zh, (cue_no+k)%2=0 AS refill, CAST(element_at(array{_AGES.replace('[', '(').replace(']', ')')}, CAST((cue_no*2+video_id+k)%3+1 AS INT)) AS TIMESTAMP) AS written_at, CAST(NULL AS BIGINT) AS en_hash, CAST(video_id%64 AS INT) AS bucket FROM {{cues}} CROSS JOIN (VALUES (0),(1)) v(k)", cues=X.cues(spark, sf))
    stored.write.partitionBy("bucket").parquet(path)
    videos = X.cues(spark, sf).select("video_id").distinct()
    log = ledger.reset_from(_ledger(spark, sf), videos.where("video_id%4=0"), "prepare_cues", 100, F.lit("2024-03-02").cast("timestamp"))
    log = ledger.reset_from(log, videos.where("video_id%4=2"), "tts", 101, F.lit("2024-03-04").cast("timestamp"))
    return read_lines(spark, path, ledger.last_resets(log, "translate")).select("video_id", "idx", "zh", F.col("refill").cast("int").alias("refill"))


@register("split_failed", f"{_REPLIES}, b AS (SELECT video_id, cue_no, CAST(floor(cue_no/100) AS BIGINT) AS batch_no, cue_no%100+1 AS local_no, count(*) OVER (PARTITION BY video_id, CAST(floor(cue_no/100) AS BIGINT)) AS n FROM cues) SELECT b.video_id, b.cue_no AS idx, b.batch_no, CAST(floor((local_no-1)/40) AS BIGINT) AS sub_no, (local_no-1)%40+1 AS sub_local_no FROM b JOIN covered c ON c.video_id=b.video_id AND c.batch_no=b.batch_no WHERE n>40 AND (c.expected-c.got)/greatest(1,c.expected) > 5e-2")
def split_failed(spark: SparkSession, sf: str) -> DataFrame:
    replies, lines, real = _real(spark, sf)
    failed = batches.batch_coverage(replies, real).where("retry")
    return batches.split_failed(batches.assign_batches(lines), failed).select("video_id", "idx", "batch_no", "sub_no", "sub_local_no")


def stub(payload: str) -> str:
    """A deterministic stand-in for a remote function: answers each line, but forgets those whose number ends in 7 in long payloads."""
    lines = payload.split("\n")
    out = []
    for line in lines:
        number, _, text = line.partition(". ")
        if not (number.endswith("7") and len(lines) > 40):
            out.append(f"{number}. 译{text}")
    return "\n".join(out)


@register("apply_batches", f"{X.duck()} SELECT video_id, CAST(floor(cue_no/100) AS BIGINT) AS batch_no, count(*) AS expected, string_agg(CASE WHEN (cue_no%100+1)%10<>7 OR n<=40 THEN concat(CAST(cue_no%100+1 AS VARCHAR), '. 译', {D.drop_fillers('text')}) END, chr(10) ORDER BY cue_no) AS body FROM (SELECT *, count(*) OVER (PARTITION BY video_id, CAST(floor(cue_no/100) AS BIGINT)) AS n FROM cues) GROUP BY 1,2")
def apply_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches.apply_batches(batches.build_requests(batches.assign_batches(_lines_of(spark, sf))), stub, 4, 1).drop("error")


_ANSWER = f"trim({D.clean_reply(D.strip('concat(' + D.q('译') + ', ' + D.drop_fillers('text') + ')', chr(34) + chr(39) + '“”'))})"


@register("refill_rounds", f"{X.duck()}, r AS (SELECT video_id, cue_no AS idx, text AS en, {_ANSWER} AS zh FROM cues) SELECT video_id, idx, zh FROM r WHERE {D.real('zh', 'en')}")
def refill_rounds(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines_of(spark, sf)
    return batches.refill_rounds(lines, batches.translate(lines, stub), stub)[0]


# ---- cues, sentences, segments

_RUNS = f"""g AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY video_id ORDER BY cue_no) > 75e-2 THEN 1 ELSE 0 END AS brk FROM cues),
r AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY cue_no ROWS UNBOUNDED PRECEDING) AS run_id FROM g),
runs AS (SELECT video_id, CAST(run_id AS BIGINT) AS run_id, min(start_s) AS start_s, arg_max(end_s, cue_no) AS end_s, count(*) AS n_cues, {D.normalize("string_agg(text, ' ' ORDER BY cue_no)")} AS text FROM r GROUP BY 1,2)"""


@register("pause_runs", f"{X.duck()}, {_RUNS} SELECT video_id, run_id, n_cues, text, {_MS} FROM runs")
def pause_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(cues.pause_runs(X.cues(spark, sf)), "run_id", "n_cues", "text")


@register("runs_of_ordered_cues", f"{X.duck()}, {_RUNS} SELECT video_id, run_id, n_cues, text, {_MS} FROM runs")
def runs_of_ordered_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Runs from a table that is dealt and sorted by video: nothing is shuffled by video_id any more."""
    import uuid

    return _ms(cues.pause_runs(K.write_ordered(X.cues(spark, sf), f"cueloom_cues_{uuid.uuid4().hex}", "cue_no", buckets=8)), "run_id", "n_cues", "text")


_MOVED = "SELECT video_id, seq AS cue_no, CASE WHEN (seq+video_id)%31=30 THEN start_s-5e0 ELSE start_s END AS start_s, end_s FROM {clips}"


@register("out_of_order", f"{X.duck('clips')}, moved AS ({_MOVED.replace('{clips}', 'clips')}), told AS (SELECT video_id, start_s < lag(start_s) OVER o AS back, end_s < max(end_s) OVER (PARTITION BY video_id ORDER BY cue_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nested FROM moved WINDOW o AS (PARTITION BY video_id ORDER BY cue_no)) SELECT * FROM (SELECT video_id, count(*) AS n_cues, count(*) FILTER (back) AS n_backward, count(*) FILTER (nested) AS n_nested FROM told GROUP BY 1) WHERE n_backward+n_nested>0")
def out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    return cues.out_of_order(spark.sql(_MOVED, clips=X.derived(spark, sf, "clips")))


_FOLD_MS = f"{D.millis('c.s')} AS start_ms, {D.millis('c.e')} AS end_ms"


@register("collapse_rolling", f"{X.duck('rolling')}, {D.collapsed('rolling')} SELECT video_id, n AS cue_no, c.t AS text, {_FOLD_MS} FROM collapsed")
def collapse_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(cues.collapse_rolling(X.derived(spark, sf, "rolling")), "cue_no", "text")


@register("suffix_delta", f"{X.duck('rolling')}, {D.deltas('rolling')} SELECT video_id, n AS cue_no, c.t AS text, {_FOLD_MS} FROM deltas")
def suffix_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(cues.suffix_delta(X.derived(spark, sf, "rolling")), "cue_no", "text")


_CLOSE = D.q(r'([.!?…]["' + "'" + r'”’)\]]*)(?:\s+|$)')
_SENTENCES = f"""parts AS (SELECT video_id, run_id, start_s, end_s, list_filter(list_transform(string_split(regexp_replace(text, {_CLOSE}, concat('\\1', chr(1)), 'g'), chr(1)), lambda p: trim(p)), lambda p: p<>'') AS a FROM runs WHERE text<>''),
sentences AS (SELECT video_id, run_id, start_s, end_s, unnest(a) AS text, unnest(generate_series(0, len(a)-1)) AS unit_no FROM parts)"""


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    runs = cues.pause_runs(X.cues(spark, sf)).where("text <> ''")
    return runs.select("video_id", "run_id", "start_s", "end_s", F.posexplode(T.split_sentences(F.col("text"))).alias("unit_no", "text")).withColumn("unit_no", F.col("unit_no").cast("long"))


@register("split_sentences", f"{X.duck()}, {_RUNS}, {_SENTENCES} SELECT video_id, run_id, unit_no, text FROM sentences")
def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).select("video_id", "run_id", "unit_no", "text")


_RECURSIVE = X.duck().replace("WITH ", "WITH RECURSIVE ", 1)
_RUN_KEY = "{'v': video_id, 'r': run_id}"
_PARTS = "SELECT k.v AS video_id, k.r AS run_id, CAST(row_number() OVER (PARTITION BY k ORDER BY part, line_no) - 1 AS INT) AS part, piece FROM lines"


@register("soft_split", f"{_RECURSIVE}, {_RUNS}, keyed AS (SELECT {_RUN_KEY} AS k, text FROM runs), {D.softened('keyed')} {_PARTS}")
def soft_split(spark: SparkSession, sf: str) -> DataFrame:
    return cues.pause_runs(X.cues(spark, sf)).select("video_id", "run_id", F.posexplode(splitting.soft_split_column()("text")).alias("part", "piece"))


@register("force_wrap", f"{_RECURSIVE}, {_RUNS}, keyed AS (SELECT {_RUN_KEY} AS k, 0 AS part, text AS t FROM runs), {D.wrapped('keyed')} {_PARTS}")
def force_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return cues.pause_runs(X.cues(spark, sf)).select("video_id", "run_id", F.posexplode(splitting.force_wrap_column()("text")).alias("part", "piece"))


_TIMED = f"""w8 AS (SELECT *, greatest(1, length(text)) AS w FROM sentences),
sums AS (SELECT *, sum(w) OVER (PARTITION BY video_id, run_id ORDER BY unit_no ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY video_id, run_id) AS t FROM w8),
ended AS (SELECT *, CASE WHEN c=t THEN end_s ELSE least(end_s, start_s + greatest(5e-2, end_s-start_s)*c/t) END AS e FROM sums),
timed AS (SELECT video_id, run_id, unit_no, coalesce(lag(e) OVER (PARTITION BY video_id, run_id ORDER BY unit_no), start_s) AS start_s, e AS end_s, text FROM ended)"""


@register("allocate_times", f"{X.duck()}, {_RUNS}, {_SENTENCES}, {_TIMED} SELECT video_id, run_id, unit_no, {_MS} FROM timed")
def allocate_times(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(segments.allocate_times(_sentences(spark, sf)), "run_id", "unit_no")


_GLUED = f"""nbr AS (SELECT *, lag(text) OVER (PARTITION BY video_id, run_id ORDER BY unit_no) AS pt, lag(end_s) OVER (PARTITION BY video_id, run_id ORDER BY unit_no) AS pe FROM timed),
marked AS (SELECT *, CASE WHEN pt IS NULL OR NOT (start_s-pe <= 75e-2 AND {D.mid_cut("pt", "text")}) THEN 1 ELSE 0 END AS fresh FROM nbr),
placed AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, run_id ORDER BY unit_no ROWS UNBOUNDED PRECEDING)-1 AS sentence_no FROM marked),
glued AS (SELECT video_id, run_id, CAST(sentence_no AS BIGINT) AS sentence_no, min(start_s) AS start_s, max(end_s) AS end_s, CASE WHEN count(*)=1 THEN min(text) ELSE {D.normalize("string_agg(text, ' ' ORDER BY unit_no)")} END AS text FROM placed GROUP BY 1,2,3)"""


@register("glue_fragments", f"{X.duck()}, {_RUNS}, {_SENTENCES}, {_TIMED}, {_GLUED} SELECT video_id, run_id, sentence_no, text, {_MS} FROM glued")
def glue_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(segments.glue_fragments(segments.allocate_times(_sentences(spark, sf))), "run_id", "sentence_no", "text")


_PACKED = f"""{D.joined_pieces('packs', 'glued', 'video_id, run_id', 'sentence_no', D.tiny('{a}') + ' OR {a}.e - {a}.s < 5e0', 1)},
packed AS (SELECT * FROM (SELECT video_id, run_id, n, c.s AS start_s, c.e AS end_s, {D.normalize('c.t')} AS text FROM packs) WHERE text <> ''),
{D.joined_pieces('absorbed', 'packed', 'video_id, run_id', 'n', D.tiny('{a}') + ' OR ' + D.tiny('{b}'), 1.1)}"""


@register("pack_segments", f"{X.duck()}, {_RUNS}, {_SENTENCES}, {_TIMED}, {_GLUED}, {_PACKED} SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY run_id, n)-1 AS INT) AS idx, c.t AS en, {_FOLD_MS} FROM absorbed")
def pack_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(segments.pack_segments(segments.allocate_times(_sentences(spark, sf))), "idx", "en")


_ABSORBED = D.joined_pieces("absorbed", "glued", "video_id", "run_id, sentence_no", D.tiny("{a}") + " OR " + D.tiny("{b}"), 1.1)


@register("absorb_micro", f"{X.duck()}, {_RUNS}, {_SENTENCES}, {_TIMED}, {_GLUED}, {_ABSORBED} SELECT video_id, CAST(n AS INT) AS idx, c.t AS en, {_FOLD_MS} FROM absorbed")
def absorb_micro(spark: SparkSession, sf: str) -> DataFrame:
    glued = segments.glue_fragments(segments.allocate_times(_sentences(spark, sf))).withColumnRenamed("text", "en")
    return _ms(segments.absorb_micro(segments.renumber(glued, ["run_id", "sentence_no"])), "idx", "en")


_UNITS = f"""{_SENTENCES.replace("sentences AS (", "whole AS (")},
keyed AS (SELECT {{'v': video_id, 'r': run_id, 'u': unit_no}} AS k, text FROM whole WHERE length(text) > 140), {D.softened("keyed")},
cut_up AS (SELECT k.v AS video_id, k.r AS run_id, k.u AS u, part, line_no, piece AS text FROM lines UNION ALL SELECT video_id, run_id, unit_no, 0, 1, text FROM whole WHERE length(text) <= 140),
sentences AS (SELECT c.video_id, c.run_id, start_s, end_s, c.text, row_number() OVER (PARTITION BY c.video_id, c.run_id ORDER BY u, part, line_no) - 1 AS unit_no FROM cut_up c JOIN runs USING (video_id, run_id))"""


@register("segment_cues", f"{_RECURSIVE}, {_RUNS}, {_UNITS}, {_TIMED}, {_GLUED}, {_PACKED} SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY run_id, n)-1 AS INT) AS idx, c.t AS en, {_FOLD_MS} FROM absorbed")
def segment_cues(spark: SparkSession, sf: str) -> DataFrame:
    return _ms(segments.segment_cues(X.cues(spark, sf)), "idx", "en")


@register("slot_with_lead", f"{X.duck()}, {_SLOTS} SELECT video_id, idx, {D.millis('slot_s')} AS slot_ms FROM slots")
def slot_with_lead(spark: SparkSession, sf: str) -> DataFrame:
    return segments.slot_with_lead(_lines_of(spark, sf)).select("video_id", "idx", timing.millis(F.col("slot_s")).alias("slot_ms"))


@register("renumber", f"{X.duck('segments')} SELECT video_id, idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY idx)-1 AS INT) AS n FROM segments WHERE zh<>''")
def renumber(spark: SparkSession, sf: str) -> DataFrame:
    return segments.renumber(_segments(spark, sf).where("zh <> ''"), ["idx"], "n").select("video_id", "idx", "n")


@register("segment_stats", f"{X.duck()}, m AS (SELECT video_id, {D.millis('end_s')}-{D.millis('start_s')} AS ms FROM cues) SELECT video_id, count(*) AS segments, CAST(floor(sum(ms)/count(*)) AS BIGINT) AS mean_ms, max(ms) AS max_ms FROM m GROUP BY 1")
def segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segment_stats(X.cues(spark, sf))


# ---- fitting and the timeline

_CHOSEN = f"""cand AS (SELECT video_id, idx, cand_no, max(dur) FILTER (fast=0 AND failed=0) AS d0, max(dur) FILTER (fast=1 AND failed=0) AS d1 FROM trials GROUP BY 1,2,3),
j AS (SELECT *, {D.rate("d0", "slot_s")} AS rate, CASE WHEN cand_no=0 THEN 'ok' ELSE 'compressed' END AS fine FROM cand JOIN slots USING (video_id, idx)),
k AS (SELECT *, d0<=slot_s*102e-2 AS plain FROM j),
v AS (SELECT *, CASE WHEN plain OR d1 IS NULL THEN 0 ELSE rate END AS r, CASE WHEN plain OR d1 IS NULL THEN d0 ELSE d1 END AS d,
  CASE WHEN plain THEN fine WHEN d1 IS NULL AND d0<=slot_s*115e-2 THEN 'tts_rate_fail' WHEN d1 IS NULL THEN 'overflow' WHEN d1<=slot_s*115e-2 THEN fine ELSE 'overflow' END AS note,
  d0 IS NOT NULL AND (plain OR d1 IS NULL OR d1<=slot_s*115e-2) AS fits,
  CASE WHEN NOT plain AND d1<d0 THEN d1 ELSE d0 END AS sd, CASE WHEN NOT plain AND d1<d0 THEN rate ELSE 0 END AS sr FROM k),
a AS (SELECT video_id, idx, slot_s, max(cand_no) AS last, max(cand_no) FILTER (d0 IS NOT NULL) AS last_ok, min(cand_no) FILTER (fits) AS first_fit, min(sd) FILTER (d0 IS NOT NULL) AS best FROM v GROUP BY 1,2,3),
s AS (SELECT a.*, (SELECT min(cand_no) FROM v WHERE v.video_id=a.video_id AND v.idx=a.idx AND v.d0 IS NOT NULL AND v.sd=a.best) AS best_no FROM a),
p AS (SELECT *, coalesce(first_fit, CASE WHEN last_ok=last THEN last END, best_no) AS pick, first_fit IS NULL AND (last_ok IS NULL OR last_ok<>last) AS short FROM s)"""


@register("choose_trial", f"{X.duck('trials')}, {_SLOTS}, {_CHOSEN} SELECT p.video_id, p.idx, p.pick AS cand_no, CASE WHEN short THEN v.sr ELSE v.r END AS rate_pct, {D.millis('CASE WHEN short THEN v.sd ELSE v.d END')} AS dur_ms, coalesce(CASE WHEN short AND v.sd<=p.slot_s*115e-2 THEN v.fine WHEN short AND v.sd IS NOT NULL THEN 'overflow' ELSE v.note END, 'no_audio') AS note FROM p LEFT JOIN v ON v.video_id=p.video_id AND v.idx=p.idx AND v.cand_no=p.pick")
def choose_trial(spark: SparkSession, sf: str) -> DataFrame:
    trials, slots = _trials_with_slots(spark, sf)
    return fit.choose_trial(trials, slots).select("video_id", "idx", "cand_no", "rate_pct", timing.millis(F.col("dur")).alias("dur_ms"), "note")


_COMPACT, _STEPS = D.shorten_steps("zh")
_ALL = ", ".join(f"t{i}" for i in range(13))


@register("shorten_candidates", f"{X.duck('segments')}, h0 AS (SELECT video_id, idx, concat(zh, '我们一个，然后，我会进行一下。 ') AS zh, concat(zh, '我们一个，然后，我会进行一下。 ') AS t0 FROM segments), {', '.join(_STEPS)}, l AS (SELECT video_id, idx, [{_ALL}, {_COMPACT}] AS a FROM h12), e AS (SELECT video_id, idx, unnest(a) AS cand, unnest(generate_series(1,14)) AS pos FROM l), f AS (SELECT video_id, idx, cand, min(pos) AS pos FROM e WHERE cand<>'' GROUP BY 1,2,3) SELECT video_id, idx, cand, CAST(row_number() OVER (PARTITION BY video_id, idx ORDER BY pos)-1 AS INT) AS cand_no FROM f")
def shorten_candidates(spark: SparkSession, sf: str) -> DataFrame:
    zh = F.concat("zh", F.lit("我们一个，然后，我会进行一下。 "))
    return _segments(spark, sf).select("video_id", "idx", F.posexplode(T.shorten_candidates(zh)).alias("cand_no", "cand"))


_HEARD = """cl AS (SELECT video_id, seq, CAST(round_even(start_s*24000,0) AS BIGINT) AS a, CAST(round_even(start_s*24000,0) AS BIGINT)+CAST(round_even((end_s-start_s)*24000,0) AS BIGINT) AS b FROM clips),
tot AS (SELECT video_id, max(b)-12000 AS total FROM cl GROUP BY 1),
pl AS (SELECT cl.video_id, seq, a, least(b,total) AS b, total FROM cl JOIN tot USING (video_id) WHERE a<least(b,total)),
cut AS (SELECT video_id, a AS x FROM pl UNION SELECT video_id, b FROM pl UNION SELECT video_id, 0 FROM tot WHERE total>0 UNION SELECT video_id, total FROM tot WHERE total>0),
iv AS (SELECT video_id, x AS f, lead(x) OVER (PARTITION BY video_id ORDER BY x) AS t FROM cut),
hd AS (SELECT iv.video_id, f, t, max(seq) AS seq FROM iv LEFT JOIN pl ON pl.video_id=iv.video_id AND a<=f AND b>=t WHERE t IS NOT NULL GROUP BY 1,2,3),
ch AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY f)>1 AND lag(seq) OVER (PARTITION BY video_id ORDER BY f) IS NOT DISTINCT FROM seq THEN 0 ELSE 1 END AS fresh FROM hd),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS g FROM ch)"""


@register("timeline_overlay", f"{X.duck('clips')}, {_HEARD} SELECT video_id, min(f) AS from_sample, max(t) AS to_sample, min(seq) AS seq FROM isl GROUP BY video_id, g")
def timeline_overlay(spark: SparkSession, sf: str) -> DataFrame:
    clips = X.derived(spark, sf, "clips")
    start = F.rint(F.col("start_s") * timeline.SAMPLES)
    ends = clips.groupBy("video_id").agg(((F.max(start + F.rint((F.col("end_s") - F.col("start_s")) * timeline.SAMPLES)) - 12_000) / timeline.SAMPLES).alias("total_s")).where("total_s > 0")
    return timeline.timeline_overlay(clips, ends)


# ---- audio, reports, retention

_AUDIO = r"""named AS (SELECT m.*, CAST(regexp_extract(m.name, '^seg_(\d+)', 1) AS BIGINT) AS idx, CASE WHEN contains(m.name,'_r') THEN 2 ELSE 0 END AS p FROM manifest m),
cands AS (SELECT n.video_id, n.idx, n.name, n.size_bytes, n.dur, n.p FROM named n JOIN segments s ON s.video_id=n.video_id AND s.idx=n.idx
  UNION ALL SELECT s.video_id, s.idx, m.name, m.size_bytes, m.dur, 1 FROM segments s JOIN manifest m ON m.video_id=s.video_id AND m.name=s.audio WHERE s.audio<>''),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, idx ORDER BY p, name) AS n FROM cands WHERE size_bytes>=500) WHERE n=1),
lost AS (SELECT video_id, idx FROM segments s WHERE trim(zh)<>'' AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.video_id=s.video_id AND m.idx=s.idx))"""
_WITH_AUDIO = X.duck("segments", "manifest") + ", " + _AUDIO


def _audio(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return _segments(spark, sf), X.derived(spark, sf, "manifest")


@register("match_audio", f"{_WITH_AUDIO} SELECT video_id, idx, name, size_bytes FROM matched")
def match_audio(spark: SparkSession, sf: str) -> DataFrame:
    return quality.match_audio(*_audio(spark, sf)).drop("dur")


@register("sorted_candidates", f"{_WITH_AUDIO} SELECT video_id, idx, name, CAST(row_number() OVER (PARTITION BY video_id, idx ORDER BY p, name) AS INT) AS place FROM cands")
def sorted_candidates(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("video_id", "idx").orderBy("priority", "name")
    return quality.audio_candidates(*_audio(spark, sf)).select("video_id", "idx", "name", F.row_number().over(order).alias("place"))


@register("missing_audio", f"{_WITH_AUDIO} SELECT * FROM lost")
def missing_audio(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_audio(*_audio(spark, sf))


@register("sample_missing", f"{_WITH_AUDIO} SELECT video_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS sample FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS n FROM lost) WHERE n<=8 GROUP BY 1")
def sample_missing(spark: SparkSession, sf: str) -> DataFrame:
    return quality.sample_missing(quality.missing_audio(*_audio(spark, sf)))


_REPORT = "rep AS (SELECT s.video_id, count(*) AS segments, count(*) FILTER (trim(zh)<>'') AS zh_nonempty, count(*) FILTER (trim(zh)<>'' AND l.idx IS NULL) AS audio_ok, coalesce(string_agg(CAST(l.idx AS VARCHAR), ',' ORDER BY l.idx), '') AS missing, count(*) FILTER (note='overflow') AS overflow, CAST(count(l.idx)=0 AND count(*) FILTER (trim(zh)<>'')>0 AS INT) AS pass FROM segments s LEFT JOIN lost l ON l.video_id=s.video_id AND l.idx=s.idx GROUP BY 1)"


def _flat_report(report: DataFrame) -> DataFrame:
    return report.select("video_id", "segments", "zh_nonempty", "audio_ok", F.array_join(F.transform("audio_missing", lambda x: x.cast("string")), ",").alias("missing"), "overflow", F.col("pass").cast("int").alias("pass"))


@register("validation_report", f"{_WITH_AUDIO}, {_REPORT} SELECT * FROM rep")
def validation_report(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_report(quality.validation_report(*_audio(spark, sf)))


@register("write_report", f"{_WITH_AUDIO}, {_REPORT} SELECT * FROM rep")
def write_report(spark: SparkSession, sf: str) -> DataFrame:
    report, path = quality.validation_report(*_audio(spark, sf)), _new_path(spark, "report")
    K.write_report(report, path)
    return _flat_report(spark.read.schema(report.schema).json(path))


_COVERAGE = f"cov AS (SELECT video_id, count(*) AS lines, count(*) FILTER ({D.real('zh', 'en')}) AS \"real\", count(*) FILTER ({D.untranslated('zh', 'en')}) AS untranslated FROM segments GROUP BY 1)"


@register("translation_coverage", f"{X.duck('segments')}, {_COVERAGE} SELECT *, CAST(\"real\" >= greatest(1, floor(lines*98e-2)) AND untranslated=0 AS INT) AS complete FROM cov")
def translation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return batches.translation_coverage(_segments(spark, sf)).withColumn("complete", F.col("complete").cast("int"))


@register("carry_over", f"{X.duck('segments')}, o AS (SELECT video_id, idx, en, zh FROM segments WHERE NOT (video_id%5=0 AND idx=0)), n AS (SELECT video_id, idx, CASE WHEN idx%2=0 THEN '' ELSE concat('新', en) END AS zh FROM segments), same AS (SELECT video_id FROM (SELECT video_id, count(*) AS k FROM n GROUP BY 1) JOIN (SELECT video_id, count(*) AS k FROM o GROUP BY 1) USING (video_id, k)) SELECT n.video_id, n.idx, CASE WHEN n.zh='' AND same.video_id IS NOT NULL AND {D.real('o.zh', 'o.en')} THEN trim(o.zh) ELSE n.zh END AS zh FROM n LEFT JOIN o ON o.video_id=n.video_id AND o.idx=n.idx LEFT JOIN same ON same.video_id=n.video_id")
def carry_over(spark: SparkSession, sf: str) -> DataFrame:
    rows = _segments(spark, sf)
    new = rows.select("video_id", "idx", F.when(F.col("idx") % 2 == 0, "").otherwise(F.concat(F.lit("新"), "en")).alias("zh"))
    return quality.carry_over(new, rows.where("not (video_id%5=0 and idx=0)"))


@register("upsert_window", f"{X.duck('segments')} SELECT video_id, idx, CASE WHEN end_s>5 AND start_s<605e-1 THEN 'done' ELSE note END AS note FROM segments")
def upsert_window(spark: SparkSession, sf: str) -> DataFrame:
    full = _segments(spark, sf)
    done = cues.overlap_filter(full, 60.5, 5.0).withColumn("note", F.lit("done"))
    return quality.upsert_window(full, done).select("video_id", "idx", "note")


_PER = "per AS (SELECT video_id, max(size_bytes) FILTER (name='out.mp4') AS s1, max(dur) FILTER (name='out.mp4') AS d1, max(size_bytes) FILTER (name='out_preview.mp4') AS s2, max(dur) FILTER (name='out_preview.mp4') AS d2, coalesce(max(dur) FILTER (name='source.mp4'), max(dur) FILTER (name='source_full.mp4')) AS src, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS b FROM outputs GROUP BY 1), ch AS (SELECT *, coalesce(s1,s2) AS s, CASE WHEN s1 IS NOT NULL THEN d1 ELSE d2 END AS d, CASE WHEN s1 IS NOT NULL THEN 'out.mp4' WHEN s2 IS NOT NULL THEN 'out_preview.mp4' END AS keep_name FROM per)"


@register("retention_plan", f"{X.duck('outputs')}, {_PER} SELECT video_id, keep_name, n-CASE WHEN keep_name IS NULL THEN 0 ELSE 1 END AS victims, b-coalesce(s,0) AS freed_bytes, CASE WHEN s IS NULL OR s<1000 THEN 'missing output' WHEN d<1 THEN 'too short' WHEN src>0 AND d+2e0<src*98e-2 THEN 'truncated' ELSE 'ok' END AS verdict FROM ch")
def retention_plan(spark: SparkSession, sf: str) -> DataFrame:
    return quality.retention_plan(_outputs(spark, sf))


_INFER = f"""a AS (SELECT video_id, bool_or(name IN ('source_full.mp4','source.mp4')) AS v, bool_or(name IN ('source.en.vtt','source.en.srt')) AS c, bool_or(name='source.mp4') AS s, bool_or(name='segments.json') AS l, bool_or(name='narration.wav') AS n, coalesce(max(dur) FILTER (name='out.mp4'), max(dur) FILTER (name='out_preview.mp4')) AS od, bool_or(name IN ('out.mp4','out_preview.mp4')) AS o, max(dur) FILTER (name='source.mp4') AS sd FROM outputs GROUP BY 1),
f AS (SELECT a.*, l AND coalesce(lines,0)>0 AS seg, \"real\" >= greatest(1, floor(lines*98e-2)) AND untranslated=0 AS tr, pass=1 AS pass FROM a LEFT JOIN cov USING (video_id) LEFT JOIN rep USING (video_id)),
st AS (SELECT video_id, unnest(['download','prepare_video','prepare_cues','merge','translate','tts','narration','compose']) AS stage, unnest([v AND c, s, seg, seg, seg AND tr, seg AND pass, n, o AND NOT coalesce(sd>0 AND od+2e0<sd*98e-2, false)]) AS ok FROM f)"""


@register("infer_done", f"{X.duck('segments', 'manifest', 'outputs')}, {_AUDIO}, {_REPORT}, {_COVERAGE}, {_INFER} SELECT video_id, stage FROM st WHERE ok")
def infer_done(spark: SparkSession, sf: str) -> DataFrame:
    rows, manifest = _audio(spark, sf)
    return quality.infer_done(_outputs(spark, sf), batches.translation_coverage(rows), quality.validation_report(rows, manifest))


# ---- the run ledger

_STAGES = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_LATEST = f"lt AS (SELECT video_id, ord, arg_max(status, seq) AS status, max(seq) AS seq FROM ledger GROUP BY 1,2), st8 AS (SELECT video_id, unnest({_STAGES}) AS stage, unnest(generate_series(0,7)) AS ord FROM (SELECT DISTINCT video_id FROM ledger)), latest AS (SELECT s.video_id, CAST(s.ord AS INT) AS ord, s.stage, coalesce(l.status,'pending') AS status, l.seq FROM st8 s LEFT JOIN lt l ON l.video_id=s.video_id AND l.ord=s.ord)"


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    return X.derived(spark, sf, "ledger")


@register("latest_stage_status", f"{X.duck('ledger')}, {_LATEST} SELECT video_id, ord, stage, status FROM latest")
def latest_stage_status(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.latest_stage_status(_ledger(spark, sf)).drop("seq")


@register("next_pending", f"{X.duck('ledger')}, {_LATEST} SELECT video_id, arg_min(stage, ord) FILTER (status IN ('pending','failed','running')) AS next_stage FROM latest GROUP BY 1")
def next_pending(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.next_pending(_ledger(spark, sf))


@register("reset_from", f"{X.duck('ledger')}, {_LATEST} SELECT video_id, ord, stage, CASE WHEN ord>=4 THEN 'pending' ELSE status END AS status FROM latest")
def reset_from(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ledger(spark, sf)
    return ledger.latest_stage_status(ledger.reset_from(rows, rows, "translate", 1000)).drop("seq")


@register("job_status", f"{X.duck('ledger')}, {_LATEST} SELECT video_id, CASE WHEN bool_and(status='done') THEN 'done' WHEN arg_max(status, seq)='failed' THEN 'failed' WHEN arg_max(status, seq)='pending' THEN 'pending' ELSE 'running' END AS status FROM latest GROUP BY 1")
def job_status(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.job_status(_ledger(spark, sf))


@register("status_report", f"{X.duck('ledger')}, {_LATEST} SELECT video_id, ord, concat(stage, '  ', status, CASE WHEN seq IS NULL THEN '' ELSE concat('  segments=', CAST(video_id AS VARCHAR), ', missing=', CAST(seq AS VARCHAR)) END) AS line FROM latest")
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    detail = F.create_map(F.lit("missing"), F.col("seq").cast("string"), F.lit("hidden"), F.lit("x"), F.lit("segments"), F.col("video_id").cast("string"))
    return ledger.status_report(_ledger(spark, sf).withColumns({"detail": detail, "error": F.lit(None).cast("string")})).drop("error")


@register("merge_meta", f"{X.duck('ledger')} SELECT video_id, concat('key', CAST(seq%3 AS VARCHAR)) AS key, arg_max(status, seq) AS value FROM ledger GROUP BY 1,2")
def merge_meta(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.merge_meta(_ledger(spark, sf).select("video_id", "seq", F.concat(F.lit("key"), (F.col("seq") % 3).cast("string")).alias("key"), F.col("status").alias("value")))


@register("resume_skip", f"{X.duck('ledger')}, {_LATEST} SELECT video_id, ord, stage FROM latest WHERE status<>'done'")
def resume_skip(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ledger(spark, sf)
    return ledger.resume_skip(ledger.all_stages(rows), rows)


@register("rows_to_resume", f"{X.duck('segments', 'ledger')}, {_LATEST} SELECT video_id, idx, {_MS}, en, zh FROM segments WHERE video_id IN (SELECT video_id FROM latest WHERE stage='tts' AND status<>'done')")
def rows_to_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Stored segments of the videos that still need speech; folders without such a video are not read."""
    path = _new_path(spark, "segments")
    K.write_segments(_segments(spark, sf), path)
    return _ms(ledger.rows_to_resume(spark.read.parquet(path), _ledger(spark, sf), "tts"), "idx", "en", "zh")


_STAGE_RESULTS = "res AS (SELECT video_id, min(CASE WHEN (expected-got)/greatest(1,expected) > 5e-2 THEN concat('batch ', CAST(batch_no AS VARCHAR), ' lacks lines') END) AS error FROM covered GROUP BY 1)"


@register("write_events", f"{_REPLIES}, {_STAGE_RESULTS} SELECT video_id, CAST(1 AS BIGINT) AS seq, 4 AS ord, 'running' AS status, '' AS error FROM res UNION ALL SELECT video_id, 2, 4, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END, coalesce(error,'') FROM res UNION ALL SELECT video_id, 3+k, 4+k, 'pending', '' FROM res CROSS JOIN (VALUES (0),(1),(2),(3)) v(k) WHERE video_id%3=0")
def write_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a stage from its batches' coverage, written twice as a repeated job would, then a reset of some videos."""
    replies, _, real = _real(spark, sf)
    path = _new_path(spark, "ledger")
    lacks = F.when(F.col("retry"), F.concat(F.lit("batch "), F.col("batch_no").cast("string"), F.lit(" lacks lines")))
    results = freeze(batches.batch_coverage(replies, real).select("video_id", lacks.alias("error")), "results")
    events = ledger.stage_events(results, "translate")
    for part in (events.where("video_id%2=0"), events, events):
        stores.write_events(part, path, "first")
    stores.write_events(ledger.reset_events(results.where("video_id%3=0"), "translate"), path, "reset")
    return stores.read_ledger(spark, path).select("video_id", "seq", "ord", "status", F.coalesce("error", F.lit("")).alias("error"))


@register("live_check", f"{X.duck('segments', 'manifest', 'ledger')}, {_AUDIO}, {_REPORT}, {_LATEST}, js AS (SELECT video_id, CASE WHEN bool_and(status='done') THEN 'done' WHEN arg_max(status, seq)='failed' THEN 'failed' WHEN arg_max(status, seq)='pending' THEN 'pending' ELSE 'running' END AS status FROM latest GROUP BY 1), few AS (SELECT video_id, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS m FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS n FROM lost) WHERE n<=10 GROUP BY 1) SELECT js.video_id, js.status, segments, zh_nonempty, audio_ok, coalesce(few.m,'') AS missing_sample FROM js JOIN rep USING (video_id) LEFT JOIN few USING (video_id)")
def live_check(spark: SparkSession, sf: str) -> DataFrame:
    return ledger_and_files(spark, sf)


def ledger_and_files(spark: SparkSession, sf: str) -> DataFrame:
    return quality.live_check(ledger.job_status(_ledger(spark, sf)), quality.validation_report(*_audio(spark, sf)))


_RUN_ROWS = "SELECT concat(url, '#', CAST(page_id AS STRING)) AS url, CASE WHEN page_id%7=0 THEN 'failed' ELSE 'done' END AS status, page_id%50 AS elapsed_s, html AS error FROM {pages}"
_DUCK_RUNS = f"WITH runs AS ({_RUN_ROWS.replace('{pages}', 'pages')})"


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_RUN_ROWS, pages=spark.read.parquet(f"{sf}/pages.parquet"))


@register("run_summary", f"{_DUCK_RUNS} SELECT count(*) FILTER (status='done') AS ok, count(*) FILTER (status='failed') AS failed, count(*) AS total, CAST(sum(elapsed_s) AS BIGINT) AS elapsed_s, CASE WHEN count(*) FILTER (status='failed')>0 THEN 1 ELSE 0 END AS exit_code FROM runs")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.run_summary(_runs(spark, sf))


@register("append_failed", rf"{_DUCK_RUNS}, l AS (SELECT url, trim(regexp_replace(error, '[\r\n]+', ' ', 'g')) AS e FROM runs WHERE status='failed') SELECT url, CASE WHEN length(e)>300 THEN concat(substr(e,1,297),'...') ELSE e END AS error FROM l")
def append_failed(spark: SparkSession, sf: str) -> DataFrame:
    path = _new_path(spark, "failed")
    K.append_failed(ledger.append_failed(_runs(spark, sf)), path)
    return K.read_failed(spark, path)


@register("caption_documents")
def caption_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain: caption files to cues, segments, requests, replies, refills, slots and SRT documents."""
    loaded = captions.load_cues(_caption_files(spark, sf, "vtt"), extend_to_next=False)
    lines = freeze(segments.segment_cues(loaded), "segments")
    real, _ = batches.refill_rounds(lines, batches.translate(lines, stub), stub)
    filled = batches.fallback_fill(batches.attach_translation(lines, real))
    slots = segments.slot_with_lead(filled)
    return K.render_srt(slots.withColumn("end_s", F.col("start_s") + F.col("slot_s")))


# ---- documents and written tables

_SRT = f"n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS k FROM segments WHERE trim(zh)<>'') SELECT video_id, string_agg(concat(CAST(k AS VARCHAR), chr(10), {D.stamp('start_s', ',')}, ' --> ', {D.stamp('end_s', ',')}, chr(10), trim(zh), chr(10)), chr(10) ORDER BY k) AS body FROM n GROUP BY 1"


@register("render_srt", f"{X.duck('segments')}, {_SRT}")
def render_srt(spark: SparkSession, sf: str) -> DataFrame:
    return K.render_srt(_segments(spark, sf))


_ESCAPED = "trim(replace(replace(zh,'{','('),'}',')'))"


@register("render_ass", f"{X.duck('segments')} SELECT video_id, concat({D.q(K.ASS_HEADER)}, string_agg(concat('Dialogue: 0,', {D.ass_stamp('start_s')}, ',', {D.ass_stamp('end_s')}, ',ZH,,0,0,0,,', {D.wrap(_ESCAPED)}), chr(10) ORDER BY idx), chr(10)) AS body FROM segments WHERE trim(zh)<>'' GROUP BY 1")
def render_ass(spark: SparkSession, sf: str) -> DataFrame:
    return K.render_ass(_segments(spark, sf))


@register("write_segments", f"{X.duck('segments')} SELECT video_id, idx, {_MS}, en, zh FROM segments")
def write_segments(spark: SparkSession, sf: str) -> DataFrame:
    path = _new_path(spark, "segments")
    K.write_segments(_segments(spark, sf), path)
    return _ms(spark.read.parquet(path), "idx", "en", "zh")


@register("write_cues", f"{X.duck()} SELECT video_id, cue_no, {_MS}, text FROM cues")
def write_cues(spark: SparkSession, sf: str) -> DataFrame:
    path = _new_path(spark, "cues")
    K.write_cues(X.cues(spark, sf), path)
    return _ms(spark.read.parquet(path), "cue_no", "text")


@register("write_batch_replies", f"{X.duck('replies')} SELECT video_id, batch_no, concat('again ', body) AS body FROM replies")
def write_batch_replies(spark: SparkSession, sf: str) -> DataFrame:
    replies, path = X.derived(spark, sf, "replies"), _new_path(spark, "replies")
    stores.write_replies(replies, path)
    stores.write_replies(replies.withColumn("body", F.concat(F.lit("again "), "body")), path)
    stores.compact_replies(spark, path)
    return stores.read_replies(spark, path)
