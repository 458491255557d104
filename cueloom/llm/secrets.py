"""Secret scans: pattern matches with positions, and how many repositories and owners hold each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.llm.columns import set_aside

# Fixed patterns, as the query states them; a match counts if the tested part is long enough.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Matches of at least the least length give the same spans for these two, since a run's first match takes all of it.
_FIND = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
#: Candidates without a keyword: long runs with letters and two digits. Only frequency decides whether they count.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9][A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "token"]
BASE = KINDS[:3]

#: A value that more owners than this hold is an example that was copied widely.
MAX_OWNERS = 2
#: A value's verdict is dealt out over so many parts, for values that stand in a large share of the rows.
SALTS = 16


def _pattern(kind: str) -> str:
    return _FIND.get(kind, TOKEN)


def _found(text: Column, kind: str) -> Column:
    """For each match, the number of code points since the match before, and the match; null if there is none."""
    p = _pattern(kind)
    walk = r"(?s)\G(.*?)(" + p + ")"
    gaps = F.transform(F.regexp_extract_all(text, F.lit(walk), F.lit(1)), F.length)
    return F.when(text.rlike(p), F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(walk), F.lit(2)).alias("hit")))


def has_candidate(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(f"(?:{_pattern(k)})" for k in KINDS)), F.lit(False))


def scan(docs: DataFrame, repo: Column, owner: Column, keep: list[str]) -> DataFrame:
    """All candidates of each row, written once: keep, repo, owner, a row number and one array per kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*keep, repo.cast("string").alias("_repo"), owner.cast("string").alias("_owner"), *[_found(text, k).alias(f"_{k}") for k in KINDS])
    return freeze(found.withColumn("_row", F.monotonically_increasing_id()), "candidates")


def candidates(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """One row per candidate span: kind, start and end in code points, value and its hash."""
    every = None
    for kind in KINDS:
        one = scanned.where(F.col(f"_{kind}").isNotNull()).select(*keep, "_row", "_repo", "_owner", F.lit(KINDS.index(kind)).alias("_kind"), F.posexplode(f"_{kind}").alias("_n", "_m"))
        every = one if every is None else every.unionByName(one)
    so_far = Window.partitionBy("_row", "_kind").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("_m.hit")
    spans = every.withColumn("end", F.sum(F.col("_m.gap") + length).over(so_far)).withColumn("start", F.col("end") - length)
    value = F.when(F.col("_kind") == 0, F.regexp_extract("_m.hit", ASSIGN, 2)).otherwise(F.col("_m.hit"))
    spans = spans.withColumn("_value", value).where((F.col("_kind") != 0) | (F.length("_value") >= LEAST["assign"]))
    spans = spans.select(*keep, "_row", "_repo", "_owner", "_kind", "start", "end", F.sha2("_value", 256).alias("_hash"))
    ahead = Window.partitionBy("_row").orderBy("start", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("_kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    is_base = F.col("_kind") < len(BASE)
    spans = spans.withColumn("_end", F.max(F.when(is_base, F.col("end"))).over(ahead)).withColumn("_start", F.min(F.when(is_base, F.col("start"))).over(behind))
    free = F.coalesce(F.col("_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_start") >= F.col("end"), F.lit(True))
    return spans.where(is_base | free).drop("_end", "_start")


def ownership(spans: DataFrame) -> DataFrame:
    """For each value's hash: repositories, owners, and whether a base pattern found it anywhere.

    A repository belongs to its owner. Counting goes from (value, owner, repository) to (value, owner) to value,
    so a value that a third of all rows hold is summed in the tasks that read it first.
    """
    held = spans.groupBy("_hash", "_owner", "_repo").agg(F.max(F.col("_kind") < len(BASE)).alias("_known"))
    by_owner = held.groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("_repos"), F.max("_known").alias("_known"))
    return by_owner.groupBy("_hash").agg(F.sum("_repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.max("_known").alias("_known"))


def _joined(spans: Column) -> Column:
    """kind:start:end of an array of (start, kind, end), in order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["_kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, keep: tuple[str, ...] = ("doc_id",), max_owners: int = MAX_OWNERS) -> DataFrame:
    """Find secrets in every whole text, and tell owner-specific ones from examples that many owners copied.

    The base patterns' spans always stay. Runs that look like credentials without a keyword (kind ``token``) are
    added where they overlap no base span and either a base pattern found the same value elsewhere in the corpus,
    or no more than max_owners owners hold it. repo is doc_id and owner is source unless given; a null owner or
    repository counts as one of its own. A null text is empty and has no spans. Rows are told apart by a number
    written with the scan, so repeated rows each get a result. Only candidates are shuffled, never texts.

    Returns keep, n_assign, n_access, n_hex, base_sha256, spans, n_token, n_live (spans whose value at most
    max_owners owners hold), n_shared, live (array of (start, end) of those) and max_repos.
    """
    kept = list(keep)
    scanned = scan(docs, F.col("doc_id") if repo is None else repo, F.col("source") if owner is None else owner, kept)
    spans = candidates(scanned, kept)
    verdicts = ownership(spans).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = spans.withColumn("_salt", F.pmod(F.xxhash64("_row", "start"), F.lit(SALTS)).cast("int")).join(verdicts, ["_hash", "_salt"])
    is_base, live = F.col("_kind") < len(BASE), F.col("owners") <= max_owners
    spans = spans.where(is_base | F.col("_known") | live)
    span = F.struct("start", "_kind", "end")
    count = lambda test: F.count(F.when(test, 1))
    found = spans.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in kept], *[count(F.col("_kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.collect_list(F.when(is_base, span))), 256).alias("base_sha256"), _joined(F.collect_list(span)).alias("spans"),
        count(live).alias("n_live"), count(~live).alias("n_shared"), F.array_sort(F.collect_list(F.when(live, F.struct("start", "end")))).alias("live"), F.max("repos").alias("max_repos"),
    )
    columns = [*kept, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token", "n_live", "n_shared", "live", "max_repos"]
    zero = F.lit(0).cast("long")
    empty = {"base_sha256": F.sha2(F.lit("").cast("binary"), 256), "spans": F.lit(""), "live": F.array().cast("array<struct<start:bigint,end:bigint>>")}
    clean = scanned.join(found.select("_row"), "_row", "left_anti").select(*kept, *[empty.get(c, zero).alias(c) for c in columns[len(kept) :]])
    return found.select(*columns).unionByName(clean.select(*columns))


def redact(docs: DataFrame, mask: str = "[secret]", max_owners: int = MAX_OWNERS) -> DataFrame:
    """The same rows and columns with every live-looking span of the text replaced by mask; spans that overlap are masked as one.

    Rows without any candidate pass straight through. The others meet their spans by doc_id and the text's 128-bit digest, both
    of which may repeat: equal rows have equal spans, so one set of spans per pair is joined. Other columns may have any
    names and stay as they are.
    """
    own, names = set_aside(docs)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")))
    hits = docs.where(has_candidate(F.col("text")))
    tagged = hits.select(*own, F.col("text").alias("text"), key.alias("_key"))
    scanned = secret_scan(hits.select("doc_id", "source", "text", key.alias("_key")), keep=("doc_id", "_key"), max_owners=max_owners)
    spans = scanned.where("n_live > 0").groupBy("_key").agg(F.first("live").alias("_live"))
    by_start = Window.partitionBy("_key").orderBy("start", "end")
    spans = spans.select("_key", F.explode("_live").alias("_s")).select("_key", "_s.start", "_s.end").withColumn("_from", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.coalesce(F.col("start") >= F.col("_from"), F.lit(True))
    place = F.struct("start", F.coalesce("_from", F.lit(0).cast("long")).alias("from"))
    spans = spans.groupBy("_key").agg(F.array_sort(F.collect_list(F.when(opens, place))).alias("_at"), F.max("end").alias("_last"))
    text = F.col("text")
    parts = F.array_join(F.transform("_at", lambda s: F.concat(F.substr(text, (s["from"] + 1).cast("int"), (s["start"] - s["from"]).cast("int")), F.lit(mask))), "")
    masked = tagged.join(spans, "_key", "left")
    masked = masked.withColumn("text", F.when(F.col("_last").isNull(), text).otherwise(F.concat(parts, F.substr(text, (F.col("_last") + 1).cast("int")))))
    back = []
    for (c, kind), n in zip(docs.dtypes, names, strict=True):
        value = F.col(n)
        if c == "text":
            value = text
        if c == "n_chars":
            value = F.when(F.col("_last").isNull(), value).otherwise(F.length("text").cast(kind))
        back.append(value.alias(c))
    return docs.where(~has_candidate(F.col("text"))).unionByName(masked.select(*back))
