"""Timed-text tables that Spark and DuckDB derive alike from the given tables, so that both sides see the same rows.

Every document is read whole and becomes a video. Manifests, ledgers and replies lack some rows by rule, because
missing files, events and lines are what their operators are about; no table that is read loses any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueloom.checkpoints import by_video, freeze

# Cues: every document is a video, every seven of its words a cue; a pause of 0.9 s follows some cues. Spark shuffles whole
# texts by doc_id, once, and cuts them in their rows; the window of _TIMES and operators by video find rows where they are.
# Words of documents that share a doc_id are one video's, in order of place and word.
_SPARK_WORDS = """
WITH d AS (SELECT doc_id AS video_id, transform(collect_list(text), x -> split(trim(x), '[ \\n]+')) AS a FROM {documents} GROUP BY 1),
c AS (SELECT video_id, CAST(k AS BIGINT) AS cue_no, text FROM d LATERAL VIEW posexplode(transform(sequence(0, CAST((array_max(transform(a, x -> size(x))) - 1) DIV 7 AS INT)), k -> CASE
  WHEN size(a) = 1 THEN concat_ws(' ', slice(a[0], k*7+1, 7))
  ELSE concat_ws(' ', transform(array_sort(flatten(transform(a, x -> transform(slice(x, k*7+1, 7), (w, i) -> struct(i, w))))), z -> z.w)) END)) t AS k, text),
"""
_DUCK_WORDS = """
w AS (SELECT doc_id AS video_id, unnest(generate_series(0,len(a)-1)) AS pos, unnest(a) AS word FROM (SELECT doc_id, regexp_split_to_array(trim(text), '[ \\n]+') a FROM documents)),
c AS (SELECT video_id, CAST(floor(pos/7) AS BIGINT) AS cue_no, string_agg(word,' ' ORDER BY pos) AS text FROM w GROUP BY 1,2),
"""
_TIMES = """
t AS (SELECT *, 60*length(text) AS dur_ms, CASE WHEN (cue_no*7919+video_id)%11=0 THEN 900 ELSE 0 END AS pause_ms FROM c),
u AS (SELECT *, sum(dur_ms+pause_ms) OVER (PARTITION BY video_id ORDER BY cue_no ROWS UNBOUNDED PRECEDING) AS z FROM t),
cues AS {materialized}(SELECT video_id, cue_no, (z-dur_ms-pause_ms)/1000e0 AS start_s, (z-pause_ms)/1000e0 AS end_s, text FROM u)
"""

#: SQL of each table over those before it, in both dialects.
DERIVED = {
    "rolling": """SELECT video_id, cue_no*3+k AS cue_no, start_s+(end_s-start_s)*k/3e0 AS start_s, start_s+(end_s-start_s)*(k+1)/3e0 AS end_s,
  CASE WHEN k=0 THEN substr(text,1,CAST(floor(length(text)/2e0) AS INT)) ELSE text END AS text FROM cues CROSS JOIN (VALUES (0),(1),(2)) v(k)""",
    "segments": """SELECT video_id, cue_no AS idx, start_s, end_s, text AS en,
  CASE WHEN (cue_no+video_id)%13=0 THEN '' WHEN (cue_no+video_id)%19=0 THEN text ELSE concat('译，', text, ' ok, 嗯，') END AS zh,
  CASE WHEN (cue_no+video_id)%29=0 THEN concat('seg_', lpad(CAST(cue_no AS STRING),4,'0'), '_r10.mp3') ELSE '' END AS audio,
  CASE WHEN (cue_no+video_id)%23=0 THEN 'overflow' ELSE 'ok' END AS note FROM cues""",
    "trials": """SELECT video_id, cue_no AS idx, cand_no, fast, (end_s-start_s)*(80+((cue_no*31+video_id*17+cand_no*7)%60))/(CASE WHEN fast=1 THEN 130e0 ELSE 100e0 END) AS dur,
  CASE WHEN (cue_no+cand_no*3+fast*5+video_id)%29=0 THEN 1 ELSE 0 END AS failed FROM cues CROSS JOIN (VALUES (0),(1),(2)) c(cand_no) CROSS JOIN (VALUES (0),(1)) f(fast)""",
    "manifest": """SELECT video_id, concat('seg_', lpad(CAST(cue_no AS STRING),4,'0'), CASE WHEN k=0 THEN '.mp3' ELSE '_r10.mp3' END) AS name,
  (cue_no*37+video_id*11+k*13)%5000 AS size_bytes, (end_s-start_s) AS dur FROM cues CROSS JOIN (VALUES (0),(1)) v(k) WHERE (cue_no+video_id+k)%13<>0""",
    "outputs": """SELECT x.video_id, n.name, (x.video_id*n.k*7919)%9000 AS size_bytes, x.total*(90+(x.video_id*n.k)%12)/100e0 AS dur
  FROM (SELECT video_id, max(end_s) AS total FROM cues GROUP BY 1) x CROSS JOIN (VALUES ('source.mp4',1),('source_full.mp4',2),('out.mp4',3),('out_preview.mp4',4),('source.en.vtt',5),('source.srt',6),('source.en.srt',7),('segments.json',8),('narration.wav',9),('source.vtt',10)) n(name,k)
  WHERE (x.video_id+n.k*3)%5<>0""",
    "ledger": """SELECT v.video_id, st.ord, a.seq*8+st.ord AS seq, CASE WHEN (v.video_id+st.ord*5+a.seq*3)%7=0 THEN 'failed' WHEN (v.video_id+st.ord+a.seq)%5=0 THEN 'running' ELSE 'done' END AS status
  FROM (SELECT DISTINCT video_id FROM cues) v CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) st(ord) CROSS JOIN (VALUES (0),(1)) a(seq) WHERE (v.video_id+st.ord*3)%6<>0""",
    "clips": "SELECT video_id, cue_no AS seq, start_s, start_s+(end_s-start_s)*(CASE WHEN cue_no%4=0 THEN 14e-1 ELSE 9e-1 END) AS end_s FROM cues",
}

#: Reply bodies: numbered lines per batch of 100 cues; some numbers left out, some given twice, some only an echo, one out of range.
_LINE = """CASE WHEN (cue_no+video_id)%13=0 THEN '' ELSE concat(CAST(cue_no%100+1 AS STRING), '. ', CASE WHEN (cue_no+video_id)%19=0 THEN text ELSE concat('"译, ', text, '"') END,
  CASE WHEN (cue_no+video_id)%17=0 THEN concat('\\n', CAST(cue_no%100+1 AS STRING), '. 好吧，again ', text) ELSE '' END) END"""
_SPARK_REPLIES = f"""SELECT video_id, CAST(floor(cue_no/100) AS BIGINT) AS batch_no, count(*) AS expected,
  concat('```text\\n', concat_ws('\\n', transform(array_sort(collect_list(struct(cue_no, {_LINE} AS line))), z->z.line)), '\\n101. too many\\n```') AS body FROM {{cues}} GROUP BY 1,2"""
_DUCK_REPLIES = f"""SELECT video_id, CAST(floor(cue_no/100) AS BIGINT) AS batch_no, count(*) AS expected,
  concat('```text\n', string_agg({_LINE.replace(chr(92) + 'n', chr(10))}, '\n' ORDER BY cue_no), '\n101. too many\n```') AS body FROM cues GROUP BY 1,2"""

#: URL lists: each third line again, some with comments, some commented out, some blank.
URL_LINES = """SELECT page_id*2+k AS line_no, CASE WHEN page_id%11=0 THEN concat('# ', url) WHEN page_id%13=0 THEN '  ' WHEN page_id%5=0 THEN concat('  ', url, ' #note ', CAST(page_id AS STRING)) ELSE url END AS line
  FROM {pages} CROSS JOIN (VALUES (0),(1)) v(k) WHERE k=0 OR page_id%3=0"""


def duck(*tables: str) -> str:
    """The WITH clause that defines cues and the named tables."""
    parts = [_DUCK_WORDS.strip().rstrip(",") + "," + _TIMES.format(materialized="MATERIALIZED ")]
    for name in tables:
        parts.append(f"{name} AS MATERIALIZED ({_DUCK_REPLIES if name == 'replies' else DERIVED[name]})")
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


_PREPARED: dict[tuple[str, str, str], DataFrame] = {}


def prepare(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, int]:
    """Write the cues and the named tables once, so that queries over them in this session start from there; the rows of each.

    Only measurements use this: they then time operators, not the making of their input.
    """
    app, rows = spark.sparkContext.applicationId, {}
    for name in ["cues", *names]:
        table = freeze(cues(spark, sf_dir) if name == "cues" else derived(spark, sf_dir, name), name)
        _PREPARED[app, sf_dir, name] = table
        rows[name] = table.count()
    return rows


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    if (ready := _PREPARED.get((spark.sparkContext.applicationId, sf_dir, "cues"))) is not None:
        return ready
    by_video(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(_SPARK_WORDS + _TIMES.format(materialized="") + " SELECT * FROM cues", documents=documents)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if (ready := _PREPARED.get((spark.sparkContext.applicationId, sf_dir, name))) is not None:
        return ready
    sql = _SPARK_REPLIES if name == "replies" else DERIVED[name].replace(" cues ", " {cues} ").replace("FROM cues", "FROM {cues}")
    return spark.sql(sql, cues=cues(spark, sf_dir))


def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(URL_LINES, pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


DUCK_URL_LINES = URL_LINES.replace("{pages}", "pages")
