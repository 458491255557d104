"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm import alignment, compression_bands, conversation_trie, lattice_lm, mixing, mpeg, packing, partenum, quality_bayes, secrets, sharding, toxicity_cnn, url_filter

#: Rows of text in one Arrow batch, which bounds a Python worker's memory where texts are long.
BATCH_ROWS = 1000

#: The list of the URL filter has the pages of hosts of these names, and of their subdomains,
LISTED_NAMES = r"(^|\.)(spam-farm|cheap-pills)\."
#: and, on whatever host, each page whose title holds at least three such runs of symbols: junk, page by page.
JUNK_RUN, JUNK_RUNS = r"[#*$%]{3}", 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Where the session leaves the size of Arrow batches at Spark's default, it is lowered for long texts; another choice stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token", "n_live", "n_shared")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(read(spark, sf_dir, "documents"))


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.audio_columns(read(spark, sf_dir, "documents")).drop("seek_offsets")


def op4_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.choose_blocks(read(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "size", "source_size", "target", "taken", mixing.shard_words(F.col("picks")).alias("shard_words"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"<title>([^<]*)", 1)
    junk = F.size(F.regexp_extract_all(title, F.lit(JUNK_RUN), F.lit(0))) >= JUNK_RUNS
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_NAMES) | junk).select("url")
    return url_filter.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text.cast("binary"))}
    placed = sharding.shards_by_bytes(read(spark, sf_dir, "documents"), 8, F.octet_length(text) + 1, ["doc_id", "text_crc32"], keep)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands.quality_rules(read(spark, sf_dir, "documents"))


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice_lm.score_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_cnn.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_nodes(read(spark, sf_dir, "conversations"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


# What SQL can say of four of these queries, so that it can be checked over whole tables; hashes and verdicts are left to the tests.


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_sainte_lague_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def byte_shard_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_byte_shards(spark, sf_dir).select("doc_id", "size", "shard", "slot")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_compression_bands(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("base_failed").cast("int").alias("base_failed"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_ngram_jaccard_join, op3_mpeg_audio, op4_sainte_lague_mix, op5_url_filter, op6_best_fit_packing, op7_byte_shards, op8_quality_bayes, op9_compression_bands, op10_lattice_lm, op11_toxicity_cnn, op12_conversation_trie, op13_tokenizer_alignment, secret_base_counts, mix_targets, byte_shard_places, quality_base_counts)
}

_OP2 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i+4], ' ') AS h FROM (SELECT doc_id, a, unnest(generate_series(1, greatest(1, len(a)-4))) AS i FROM w WHERE len(a)>0)),
n AS (SELECT w.doc_id, count(s.h) AS n FROM w LEFT JOIN s ON s.doc_id=w.doc_id GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.h=y.h AND x.doc_id<>y.doc_id GROUP BY 1,2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id=a JOIN n nb ON nb.doc_id=b WHERE 100*shared >= 80*(na.n+nb.n-shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a=r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, count(*) OVER (PARTITION BY component_id) AS component_size FROM n JOIN c USING (doc_id)"""

_OP5 = r"""WITH p AS (SELECT page_id, url, strpos(url, '://')>0 AS ok, substr(url, strpos(url, '://')+3) AS rest, len(regexp_extract_all(regexp_extract(html, '<title>([^<]*)', 1), '[#*$%]{3}'))>=3 AS junk FROM pages),
h AS (SELECT page_id, ok, rest, junk, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS qs FROM h),
c AS (SELECT *, CASE WHEN ok THEN concat(regexp_replace(host, '^(?:www|m|blog)\.', ''), regexp_replace(path, '(?:\.html?|/)+$', ''), CASE WHEN qs<>'' THEN concat('?', qs) ELSE '' END) END AS canon FROM k),
l AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND (junk OR regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.'))),
j AS (SELECT c.*, l.canon IS NOT NULL AS listed FROM c LEFT JOIN l ON l.canon=c.canon),
r AS (SELECT *, CASE WHEN (host='example.net' OR ends_with(host,'.example.net')) AND starts_with(path,'/en/') THEN 'example.net/en/' WHEN (host='example.com' OR ends_with(host,'.example.com')) AND starts_with(path,'/de/') THEN 'example.com/de/'
  WHEN (host='org' OR ends_with(host,'.org')) AND starts_with(path,'/fr/') THEN 'org/fr/' WHEN (host='net' OR ends_with(host,'.net')) AND starts_with(path,'/') THEN 'net/' END AS rule FROM j)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict, listed FROM r"""

_WORDS = r"'[^\x20\x09-\x0D]+'"

_SECRETS = r"""WITH t AS (SELECT doc_id, coalesce(text,'') AS x FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(x, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 12)) AS n_assign,
len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda v: length(v) >= 18)) AS n_access, len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda v: length(v) >= 16)) AS n_hex FROM t"""

_MIX = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), {_WORDS})) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2e0 AS cap, sum(source_size) OVER () * 15e-1 AS total FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k, coalesce(sum(cap) OVER f, 0) AS full_cap, coalesce(sum(weight) OVER f, 0) AS full_weight, sum(weight) OVER () AS weights FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - full_cap) / (weights - full_weight) AS level FROM r),
c AS (SELECT arg_min(level, k) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM c) * weight, cap)) AS target FROM l)
SELECT doc_id, size, source_size, round(target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

_SHARDS = """WITH s AS (SELECT doc_id, strlen(coalesce(text,'')) + 1 AS size FROM documents),
b AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s),
p AS (SELECT *, least(7, floor((2 * before + size)::DOUBLE * 8 / (2e0 * total)))::INT AS shard FROM b)
SELECT doc_id, size, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot FROM p"""

_QUALITY = f"""WITH t AS (SELECT doc_id, coalesce(text,'') AS x, regexp_extract_all(coalesce(text,''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, hash(w[i:i+4]) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w)-4)) AS i FROM t WHERE len(w) > 4)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (VALUES (0),(1),(2),(3),(4)) v(k) GROUP BY 1),
ln AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line FROM t),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, {_WORDS}) GROUP BY 1),
c AS (SELECT t.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM t LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, CAST(n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS INT) AS base_failed FROM c"""

_TRIE = """WITH t AS (SELECT conv_id, coalesce(text,'') AS text, coalesce(role,'') AS role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,'')) AS i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(sha256(concat(length(role), ':', role, text)) ORDER BY i) AS a, list(length(text) ORDER BY i) AS n FROM t GROUP BY 1),
h AS (SELECT *, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda c, x: list_reduce(range(8), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, x)), 4294967295::BIGINT), 4294967295) % 6 AS h FROM o),
r AS (SELECT h.conv_id, coalesce(list_concat(b.a[1:h.h], h.a[h.h+1:]), h.a[h.h+1:]) AS a, coalesce(list_concat(b.n[1:h.h], h.n[h.h+1:]), h.n[h.h+1:]) AS n FROM h LEFT JOIN h b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, d, sha256(array_to_string(a[1:d], '')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(a[1:d-1], '')) END AS up, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars, d = len(a) AS ends FROM (SELECT *, unnest(generate_series(0, len(a))) AS d FROM r)),
x AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM m GROUP BY 1, 2),
c AS (SELECT up, count(*) AS n_children FROM x GROUP BY 1),
y AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM x LEFT JOIN c ON c.up = x.k),
s AS (SELECT m.d, m.k, sum(CASE WHEN y.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((y.n_convs - 1) * y.chars)::BIGINT AS saved_tokens FROM y JOIN m ON m.conv_id = y.conv_id AND m.d <= y.d GROUP BY 1, 2)
SELECT y.conv_id, y.d AS depth, p.conv_id AS parent_conv_id, y.n_convs, y.n_children, s.n_leaves, s.saved_tokens, sha256(y.ids) AS ends_sha256 FROM y JOIN s ON s.d = y.d AND s.k = y.k LEFT JOIN y p ON p.k = y.up AND p.d = y.d - 1"""

#: The others use hashes, checksums, compression, tokenizers or seeded choices that SQL lacks; tests/llm has plain versions.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": _OP2, "op5_url_filter": _OP5, "secret_base_counts": _SECRETS, "mix_targets": _MIX, "byte_shard_places": _SHARDS, "quality_base_counts": _QUALITY, "op12_conversation_trie": _TRIE,
}
