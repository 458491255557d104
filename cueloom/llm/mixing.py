"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.llm.columns import set_aside

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix takes this share of all words, and no source more than MAX_EPOCHS times.
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_TOKENS = 64
N_SHARDS = 8
#: Documents of a source are dealt over so many buckets for their prefix sums, so that no task sees a whole source.
BUCKETS = 256
#: Sources up to which their plan (about 60 bytes each) is broadcast to their buckets; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000
SPACES = r"[ \t\n\x0B\f\r]+"


def word_count(text: Column) -> Column:
    """Number of runs other than space and the bytes 09 to 0D; 0 for null. Each run is cut to one character, so no list of words is made."""
    return F.coalesce(F.length(F.regexp_replace(text, r"([^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r]*|" + SPACES, "$1")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """Add weight and target to a table of one row per source (source, source_size).

    Weights repeat over the sources by code point, null last. The share of all words is dealt by weight; a target
    stops at max_epochs times its source's size and the excess goes to the others by weight. In order of size by
    weight, the sources before the first that stays under its cap are full, which running sums tell.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(max_epochs)).withColumn("_all", F.sum("source_size").over(everything) * float(min(share, max_epochs)))
    by_cap = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(by_cap), F.lit(0.0)))
    ranked = ranked.withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    ranked = ranked.withColumn("_level", F.col("_left") / F.col("_weights"))
    in_order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level")), ignorenulls=True).over(in_order)
    return ranked.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap")))).select("source", "source_size", "weight", "target")


def apportion(table: DataFrame, votes: str, seats: str, by: str) -> DataFrame:
    """Deal each group's seats to its rows by the highest quotients votes / (2q + 1), as quota; ties go to the first source by name.

    table has source, votes, and for each group (by) the number of seats. A row's seat q has its quotient above 1/x
    exactly while (2q + 1) / votes < x. With S rows and V votes in all, x = (2 * seats - S) / V gives at most all
    seats, and the rest are at most S more, found among the next quotients by one sort. Dealing more seats never
    takes one away, so differences between growing groups are quotas too.
    """
    group = Window.partitionBy(by)
    t = table.withColumn("_votes", F.sum(votes).over(group)).withColumn("_rows", F.count(F.when(F.col(votes) > 0, 1)).over(group))
    low = (2 * F.col(seats) - F.col("_rows")) / F.col("_votes")
    high = (2 * F.col(seats) + F.col("_rows")) / F.col("_votes")
    sure = F.when((F.col(votes) > 0) & (low > 0), F.floor((low * F.col(votes) + 1) / 2)).otherwise(F.lit(0)).cast("long")
    t = t.withColumn("_sure", sure).withColumn("_rest", F.col(seats) - F.sum("_sure").over(group))
    more = t.where(F.col(votes) > 0).withColumn("_q", F.explode(F.sequence(F.col("_sure"), F.greatest(F.col("_sure"), F.ceil((high * F.col(votes) + 1) / 2)))))
    order = Window.partitionBy(by).orderBy((F.col(votes) / (2 * F.col("_q") + 1)).desc(), F.col("source").asc_nulls_last(), "_q")
    won = more.withColumn("_n", F.row_number().over(order)).where("_n <= _rest").groupBy(by, "source").agg(F.count(F.lit(1)).alias("_won"))
    every = t.select(by, "source", F.col("_sure").alias("_won")).unionByName(won.select(by, "source", "_won"))
    return every.groupBy(by, "source").agg(F.sum("_won").alias("quota"))


def plan_sources(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int, block: int, n_shards: int) -> DataFrame:
    """One row per source: source_size, target, blocks, quota of blocks in all and shard_ends, how many of them the first output shard, the first two and so on get."""
    t = targets(sizes, weights, share, max_epochs)
    houses = t.withColumn("_shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
    seats = F.round(F.sum("target").over(Window.partitionBy("_shard")) / block * F.col("_shard") / n_shards).cast("long")
    dealt = apportion(houses.withColumn("_seats", seats), "target", "_seats", "_shard")
    so_far = F.transform(F.array_sort(F.collect_list(F.struct("_shard", "quota"))), lambda s: s["quota"])
    dealt = dealt.groupBy("source").agg(F.max("quota").alias("quota"), so_far.alias("_so_far"))
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    joined = t.join(dealt.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    most = F.col("blocks") * max_epochs
    return joined.withColumns({"quota": F.least("quota", most), "shard_ends": F.transform("_so_far", lambda q: F.least(q, most))}).drop("_source", "_so_far")


#: Multipliers of the block permutation; one that shares no factor with the number of blocks is used.
_PRIMES = (2654435761, 2246822519, 3266489917)


def _place(block_no: Column, blocks: Column, seed: Column) -> Column:
    """Where a block stands in its source's seeded order: a permutation of 0 to blocks - 1."""
    factor = None
    for p in _PRIMES:
        test = blocks % p != 0  # p is prime, so it shares no factor with what it does not divide
        factor = F.when(test, F.lit(p) % blocks) if factor is None else factor.when(test, F.lit(p) % blocks)
    step = F.coalesce(factor, F.lit(1))
    product = block_no.cast("decimal(19,0)") * step.cast("decimal(19,0)") + F.pmod(seed, blocks).cast("decimal(19,0)")
    return F.pmod(product, blocks.cast("decimal(19,0)")).cast("long")


def sized(docs: DataFrame, seed: int, keep: list[str]) -> DataFrame:
    """Sizes, written once, with a seeded order of the documents of each source."""
    t = docs.select(*keep, F.col("source"), F.col("text").alias("_text"), F.col("doc_id").alias("_doc"))
    t = t.withColumn("size", word_count(F.col("_text"))).withColumn("_order", F.xxhash64(F.lit(seed), F.col("_doc"), F.xxhash64("_text"))).drop("_text", "_doc")
    return freeze(t.withColumn("_row", F.monotonically_increasing_id()), "sizes")


def choose_blocks(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_TOKENS, n_shards: int = N_SHARDS, seed: int = 17, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What the mix takes of each document.

    A source's documents, in a seeded order, form one stream of words cut into equal blocks. Highest quotients
    give each source a whole number of blocks in every output shard. A seeded permutation of the source's blocks,
    gone through again in each round, is dealt to the shards in order: each takes as many of the next blocks as its quota says. Prefix sums
    within a source run over buckets, so a source with a third of all rows is spread over BUCKETS tasks. The only
    table that a single task sorts has one row per source; it is broadcast while there are few.

    Null texts have size 0 and are never taken; null sources form the last source; repeated rows are documents
    of their own. Returns keep, source, size, source_size, target, taken, and picks: for each block of the
    document, (start, length) in words, how often it is taken (rounds) and for which shard each time (shards).
    """
    t = sized(docs, seed, list(keep)).withColumn("_bucket", F.pmod("_order", F.lit(BUCKETS)).cast("int"))
    buckets = t.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sizes = buckets.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    plan = plan_sources(sizes, weights, share, max_epochs, block, n_shards)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).select(F.struct("source", "_bucket").alias("_key"), "_base")
    plan = freeze(plan.select(F.struct("source").alias("_s"), "source_size", "target", "blocks", "quota", "shard_ends"), "plan", few=True)
    few = plan.count() <= BROADCAST_SOURCES
    bases = bases.join(F.broadcast(plan) if few else plan, F.struct("_key.source").eqNullSafe(F.col("_s")))
    here = Window.partitionBy("source", "_bucket").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_before", F.sum("size").over(here) - F.col("size")).join(bases, F.struct("source", "_bucket").eqNullSafe(F.col("_key")))
    t = t.withColumn("_from", F.col("_base") + F.col("_before")).withColumn("_to", F.col("_from") + F.col("size"))
    seeded = F.xxhash64(F.lit(seed), "source")

    def placed(b: Column) -> Column:
        start = F.greatest(b * block, F.col("_from"))
        return F.struct((start - F.col("_from")).alias("start"), (F.least((b + 1) * block, F.col("_to")) - start).alias("length"), _place(b, F.col("blocks"), seeded).alias("place"))

    def pick(p: Column) -> Column:
        rounds = (F.floor(F.col("quota") / F.col("blocks")) + F.when(p["place"] < F.col("quota") % F.col("blocks"), 1).otherwise(0)).cast("long")
        shard_of = lambda turn: F.size(F.filter("shard_ends", lambda end: end <= p["place"] + turn * F.col("blocks")))
        shards = F.when(rounds > 0, F.transform(F.sequence(F.lit(0).cast("long"), rounds - 1), shard_of)).otherwise(F.array().cast("array<int>"))
        return F.struct(p["start"], p["length"], rounds.alias("rounds"), shards.alias("shards"))

    first, last = F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block)
    places = F.when(F.col("size") > 0, F.transform(F.sequence(first, last), placed)).otherwise(F.array())
    picks = F.transform(places, pick)
    t = t.withColumn("picks", picks)
    taken = F.aggregate("picks", F.lit(0).cast("long"), lambda a, p: a + p["length"] * p["rounds"])
    return t.withColumn("taken", taken).select(*keep, "source", "size", "source_size", "target", "taken", "picks")


def shard_words(picks: Column, n_shards: int = N_SHARDS) -> Column:
    """How many words each output shard takes, of a document's picks."""
    of = lambda shard: F.aggregate(picks, F.lit(0).cast("long"), lambda a, p: a + p["length"] * F.size(F.filter(p["shards"], lambda s: s == shard)))
    return F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), of)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of docs, one row per document and round that takes words of it.

    A round that takes every word keeps the text as it is; otherwise the text is the taken words, joined by
    single spaces. The rows meet their picks by doc_id, source and text hash; equal rows get equal numbers of
    picks, told apart by their number among equals. Other columns may have any names and stay as they are.
    """
    kept, names = set_aside(docs)
    key = ["doc_id", "_hash"]
    tagged = docs.select(*kept, "doc_id", "source", "text").where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).withColumn("_hash", F.xxhash64("text", "source"))  # others are never taken
    numbered = tagged.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))
    chosen = choose_blocks(tagged, keep=("doc_id", "_hash"), **options).where("taken > 0").select("doc_id", "_hash", "size", "picks")
    chosen = chosen.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json("picks"))))
    chosen = chosen.withColumnsRenamed({c: f"_c_{c}" for c in chosen.columns})
    mixed = numbered.join(chosen, F.struct(*key, "_n").eqNullSafe(F.struct(*[f"_c_{c}" for c in (*key, "_n")])))
    rounds = F.array_max(F.transform("_c_picks", lambda p: p["rounds"]))
    mixed = mixed.withColumn("_round", F.explode(F.sequence(F.lit(1).cast("long"), rounds)))
    mixed = mixed.withColumn("_mine", F.filter("_c_picks", lambda p: p["rounds"] >= F.col("_round"))).withColumn("_len", F.aggregate("_mine", F.lit(0).cast("long"), lambda a, p: a + p["length"]))
    words = F.split(F.regexp_replace("text", r"^" + SPACES + "|" + SPACES + "$", ""), SPACES)
    part = F.array_join(F.flatten(F.transform("_mine", lambda p: F.slice(F.col("_words"), (p["start"] + 1).cast("int"), p["length"].cast("int")))), " ")
    mixed = mixed.withColumn("_words", F.when(F.col("_len") < F.col("_c_size"), words))
    mixed = mixed.withColumn("text", F.when(F.col("_words").isNull(), F.col("text")).otherwise(part))
    return mixed.select(*_put_back(docs, names, {"text": F.col("text"), "n_chars": F.length("text")}))


def _put_back(docs: DataFrame, names: list[str], changed: dict[str, Column]) -> list[Column]:
    """The columns of docs under their own names and types again, some with new values."""
    return [(changed[c].cast(t) if c in changed else F.col(n)).alias(c) for (c, t), n in zip(docs.dtypes, names, strict=True)]
