"""Rows with or without given ids, told in the scan by a cascade of two Bloom filters, so that hardly any row is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.llm.columns import set_aside

#: A block has so many lanes of 64 bits; each id sets one bit of each.
LANES = 8
#: Ids that a block is made for: of other ids about one in 500 passes.
IDS_A_BLOCK = 40
#: Blocks at most (about 110 bytes each while broadcast, 58 MB in all). Beyond 20 million ids the filter fills: more rows are shuffled, and results stay the same.
MOST_BLOCKS = 1 << 19


def _bits(key: Column) -> list[Column]:
    """One bit of 64 for each lane, from successive groups of six bits of the key's hash."""
    h, one = F.xxhash64(key), F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(LANES)]


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(n)).cast("int")


class Filter:
    """A blocked Bloom filter of ids (column _id, n_ids rows), as a broadcast table of its used blocks."""

    def __init__(self, ids: DataFrame, n_ids: int) -> None:
        self.n = 1
        while self.n < MOST_BLOCKS and self.n * IDS_A_BLOCK < n_ids:
            self.n *= 2
        lanes = ids.select(_block(F.col("_id"), self.n).alias("_block"), *[b.alias(f"_lane{i}") for i, b in enumerate(_bits(F.col("_id")))])
        self.blocks = freeze(lanes.groupBy("_block").agg(*[F.bit_or(f"_lane{i}").alias(f"_lane{i}") for i in range(LANES)]), "filter", few=True)

    def mark(self, rows: DataFrame, key: str, flag: str) -> DataFrame:
        """Rows with flag: whether the column key may be among the ids; never for null."""
        met = rows.join(F.broadcast(self.blocks), _block(F.col(key), self.n) == F.col("_block"), "left")
        held = F.col(key).isNotNull()
        for i, bit in enumerate(_bits(F.col(key))):
            held = held & (F.col(f"_lane{i}").bitwiseAND(bit) != 0)
        return met.select(*rows.columns, F.coalesce(held, F.lit(False)).alias(flag))


def with_ids(rows: DataFrame, key: Column, ids: DataFrame, known: DataFrame, inside: bool) -> DataFrame:
    """The rows whose key is among ids (inside), or those where it is not or is null; all columns as they are.

    ids and known are written tables of one column _id of the key's type: the ids in question, once each, and all keys
    that rows have (repeats and nulls do not matter). The first filter holds the ids, the second those other keys that
    pass the first. What passes one alone is certain; only what passes both, a few in a thousand, is shuffled
    to meet the ids. Rows are scanned once for the certain and once for the others.
    """
    first = Filter(ids, ids.count())
    passed = first.mark(known.where("_id is not null"), "_id", "_hit").where("_hit").select("_id")
    passed = freeze(passed.join(ids.hint("merge"), "_id", "left_anti").distinct(), "passed", few=True)
    second = Filter(passed, passed.count())
    columns, names = set_aside(rows)
    marked = second.mark(first.mark(rows.select(*columns, key.alias("_id")), "_id", "_hit"), "_id", "_again")
    sure = marked.where("_hit and not _again" if inside else "not _hit")
    met = marked.where("_hit and _again").join(ids.hint("merge"), "_id", "left_semi" if inside else "left_anti")
    back = [F.col(n).alias(c) for n, c in zip(names, rows.columns, strict=True)]
    return sure.select(*back).union(met.select(*back))
