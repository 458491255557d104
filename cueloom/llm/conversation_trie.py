"""Prefix trie of rebuilt conversations, from products of turn hashes that combine without rebuilding any text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze, release

#: A conversation begins with the first turns of the one whose number ends in so many zeros: group of GROUP numbers, HEADS lengths.
GROUP = 100
HEADS = 6
#: Products are taken modulo this prime under four bases, two to a 62-bit word.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_013, 1_812_433_253, 69_621_417)
#: Texts of turns with equal numbers are put in order by so many characters, and by their hashes beyond.
ORDER_CHARS = 64
#: Depths of one conversation, and numbers of conversations that end at one node, are handled together in blocks of so many.
BLOCK = 4096
#: Parents with more than this share of all children, so fewer than its inverse, are joined by broadcast.
HOT_SHARE = 1 / 5000
SEEDS = 8
_LOW = (1 << 31) - 1


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def _power_table(base: int, n: int) -> np.ndarray:
    table = np.ones(1, np.int64)
    while len(table) < n:
        table = np.concatenate([table, table * pow(base, len(table), PRIME) % PRIME])
    return table


def _running(bases: tuple[int, ...]):
    """Running products of each conversation's stretch of a sorted partition, from (conv_id, ha, hb, chars).

    The product of turns 0, 1, ... is the sum of their hashes times 1, base, base squared, ...: products of adjoining
    stretches combine by one multiplication and one addition. Only the last row's values are kept between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_power_table(b, 1024) for b in bases]
        last, at0, chars0, sums0 = None, 0, 0, [0] * len(bases)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, ha, hb, chars = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            new = np.ones(n, bool)
            new[1:] = conv[1:] != conv[:-1]
            new[0] = last is None or conv[0] != last
            begins = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            carried = begins < 0
            at = np.where(carried, np.arange(n) + at0, np.arange(n) - begins)
            if at.max() >= len(tables[0]):
                tables = [_power_table(b, int(at.max()) + 1) for b in bases]
            halves = [h.view(np.uint64) for h in (ha, hb)]
            hashes = [(h >> np.uint64(shift)).astype(np.int64) & _LOW for h in halves for shift in (33, 0)]
            upto, before = [], []
            for k, h in enumerate(hashes):
                terms = h % PRIME * tables[k][at] % PRIME
                sums = np.cumsum(terms)
                base = np.where(carried, -sums0[k], (sums - terms)[np.maximum(begins, 0)])
                upto.append((sums - base) % PRIME)
                before.append((sums - terms - base) % PRIME)
            counted = np.cumsum(chars)
            chars_upto = counted - np.where(carried, -chars0, (counted - chars)[np.maximum(begins, 0)])
            last, at0, chars0, sums0 = conv[-1], int(at[-1]) + 1, int(chars_upto[-1]), [int(u[-1]) for u in upto]
            packed = [x[k] << 31 | x[k + 1] for x in (upto, before) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(batch.num_columns)], pa.array(at), *map(pa.array, packed), pa.array(chars_upto)], names=[*batch.schema.names, "at", "fa", "fb", "pa", "pb", "upto"])

    return run


def _parts(a: Column, b: Column) -> list[Column]:
    return [F.shiftright(a, 31), a.bitwiseAND(_LOW), F.shiftright(b, 31), b.bitwiseAND(_LOW)]


def _packed(parts: list[Column]) -> tuple[Column, Column]:
    return tuple(F.shiftleft(parts[k], 31).bitwiseOR(parts[k + 1]) for k in (0, 2))


def _plus(x: list[Column], y: list[Column]) -> list[Column]:
    return [(a + b) % PRIME for a, b in zip(x, y, strict=True)]


def _powers(n: Column) -> list[Column]:
    """The four bases to the power of a count, by its bits."""
    out = []
    for base in BASES:
        steps = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(pow(base, 1 << k, PRIME)).cast("long").alias("by")) for k in range(48)])
        out.append(F.when(n == 0, F.lit(1).cast("long")).otherwise(F.aggregate(steps, F.lit(1).cast("long"), lambda a, s: F.when(n.bitwiseAND(s["bit"]) != 0, a * s["by"] % PRIME).otherwise(a))))
    return out


def _shifted(parts: list[Column], back: Column) -> list[Column]:
    """Products divided by the bases to the power of back, which is below HEADS."""
    inverse = [F.get(F.array(*[F.lit(pow(base, -k, PRIME)).cast("long") for k in range(HEADS)]), back.cast("int")) for base in BASES]
    return [p * i % PRIME for p, i in zip(parts, inverse, strict=True)]


def _hashed(conversations: DataFrame, seed: int, hash_bits: int) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mask = -1 if hash_bits == 64 else (1 << hash_bits) - 1
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return turns.withColumns({n: F.xxhash64(F.lit(2 * seed + k), "role", "text").bitwiseAND(F.lit(mask).cast("long")) for k, n in enumerate(("ha", "hb"))})


def _clashing(hashed: DataFrame) -> bool:
    """Whether two different turns have the same two hashes: the texts themselves are compared."""
    turn = F.struct("role", "text")
    return not hashed.groupBy("ha", "hb").agg(F.min(turn).alias("a"), F.max(turn).alias("b")).where("a <> b").isEmpty()


def _runs(turns: DataFrame) -> DataFrame:
    """Stretches of conversations in partitions, with what comes before them and their conversation's first turns among theirs."""
    first = F.struct("at", "fa", "fb", "pa", "pb", "ha", "hb", "chars", "upto")
    runs = turns.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.max_by("fa", "at").alias("fa"), F.max_by("fb", "at").alias("fb"), F.collect_list(F.when(F.col("at") < HEADS - 1, first)).alias("firsts"),
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"n0": F.coalesce(F.sum("n").over(before), F.lit(0)), "chars0": F.coalesce(F.sum("chars").over(before), F.lit(0))})
    moved = [p * w % PRIME for p, w in zip(_parts(F.col("fa"), F.col("fb")), _powers(F.col("n0")), strict=True)]
    runs = runs.withColumns({f"m{k}": m for k, m in enumerate(moved)} | {f"w{k}": w for k, w in enumerate(_powers(F.col("n0")))})
    return runs.withColumns({f"s{k}": F.coalesce(F.sum(f"m{k}").over(before) % PRIME, F.lit(0)) for k in range(4)}).drop("fa", "fb", *[f"m{k}" for k in range(4)])


def _whole(parts: list[Column]) -> list[Column]:
    """Products from the conversation's beginning, of rows that know those from their stretch's beginning."""
    return [(F.col(f"s{k}") + F.col(f"w{k}") * p) % PRIME for k, p in enumerate(parts)]


def _placed_first(x: Column) -> Column:
    fa, fb = _packed(_whole(_parts(x["fa"], x["fb"])))
    pa_, pb = _packed(_whole(_parts(x["pa"], x["pb"])))
    return F.struct((F.col("n0") + x["at"] + 1).alias("k"), fa.alias("fa"), fb.alias("fb"), pa_.alias("pa"), pb.alias("pb"), x["ha"].alias("ha"), x["hb"].alias("hb"), x["chars"].alias("chars"), (F.col("chars0") + x["upto"]).alias("upto"))


def _conversations(runs: DataFrame) -> DataFrame:
    """Each conversation with its length, the head it takes over, and what its rebuilt form has where the head ends.

    A conversation has no more first turns than HEADS - 1, whatever its length, and a group's first conversation is
    joined by no more than 2 * GROUP others.
    """
    firsts = F.when(F.col("n0") < HEADS - 1, F.filter(F.transform("firsts", _placed_first), lambda x: x["k"] < HEADS))
    convs = freeze(runs.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("total"), F.flatten(F.collect_list(firsts)).alias("firsts")), "conversations")
    bases = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"), F.col("firsts").alias("_firsts"))
    rows = convs.withColumns({"_of": F.col("conv_id") - F.col("conv_id") % GROUP, "h": head_length(F.col("conv_id"))}).join(bases, F.col("_of") == F.col("_base"), "left")
    rows = rows.withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0))))
    at = lambda firsts, k: F.get(F.filter(firsts, lambda x: x["k"] == k), F.lit(0))
    head, own = at("_firsts", F.col("taken")), at("firsts", F.col("h"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    rows = rows.withColumns({"ba": zero(head["fa"]), "bb": zero(head["fb"]), "bchars": zero(head["upto"]), "oa": zero(own["fa"]), "ob": zero(own["fb"]), "ochars": zero(own["upto"])})
    rows = rows.withColumns({"depths": F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)), "all_chars": F.col("bchars") + F.when(F.col("n") > F.col("h"), F.col("total") - F.col("ochars")).otherwise(0)})
    heads = F.filter(F.coalesce("_firsts", F.array().cast(convs.schema["firsts"].dataType)), lambda x: x["k"] <= F.col("taken"))
    return freeze(rows.select("conv_id", "h", "taken", "ba", "bb", "bchars", "oa", "ob", "ochars", "depths", "all_chars", heads.alias("heads")), "rebuilt")


def _members(turns: DataFrame, runs: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, fa, fb, pa, pb, ha, hb, chars, before, ends): each prefix of each rebuilt conversation, by its product and its parent's, with its last turn."""
    of_run = runs.drop("firsts", "n", "chars").join(convs.drop("heads", "all_chars").hint("merge"), "conv_id").withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    rows = turns.join(of_run.hint("merge"), (F.col("conv_id") == F.col("_conv")) & (F.col("part") == F.col("_part"))).withColumn("k", F.col("n0") + F.col("at") + 1).where("k > h")
    rebuilt = {}
    for a, b in (("fa", "fb"), ("pa", "pb")):
        own = [(x + PRIME - y) % PRIME for x, y in zip(_whole(_parts(F.col(a), F.col(b))), _parts(F.col("oa"), F.col("ob")), strict=True)]
        rebuilt[a], rebuilt[b] = _packed(_plus(_parts(F.col("ba"), F.col("bb")), _shifted(own, F.col("h") - F.col("taken"))))
    depth = F.col("taken") + F.col("k") - F.col("h")
    before = F.col("bchars") + F.col("chars0") + F.col("upto") - F.col("chars") - F.col("ochars")
    last = lambda depth: (depth == F.col("depths")).cast("int").alias("ends")
    own = rows.select("conv_id", depth.cast("long").alias("depth"), *[c.alias(n) for n, c in rebuilt.items()], "ha", "hb", "chars", before.alias("before"), last(depth))
    x = F.col("x")
    heads = convs.select("conv_id", "depths", F.explode("heads").alias("x")).select("conv_id", x["k"].alias("depth"), *[x[c].alias(c) for c in ("fa", "fb", "pa", "pb", "ha", "hb", "chars")], (x["upto"] - x["chars"]).alias("before"), last(x["k"]))
    root = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "fa", "fb", "pa", "pb", "ha", "hb", "chars", "before")], last(F.lit(0)))
    return freeze(own.unionByName(heads).unionByName(root), "members")


_KEY = ["depth", "fa", "fb"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, from sorted (depth, fa, fb, block, ids); only the running digest is kept."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": [key[0]], "fa": [key[1]], "fb": [key[2]], "ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        done = []
        for *own, ids in zip(*[batch.column(c).to_pylist() for c in (0, 1, 2, 4)], strict=True):
            if own != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([*[pa.array([d[c] for d in done], pa.int64()) for c in range(3)], pa.array([d[3] for d in done])], names=[*_KEY, "ends_sha256"])
    if key is not None:
        yield row()


def _ends(members: DataFrame) -> DataFrame:
    """Digest of the numbers of conversations that end at a node. Numbers are joined in blocks of BLOCK, so a node where very many end is one task's for a few rows only."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = members.where("ends = 1").groupBy(*_KEY, F.floor(F.col("conv_id") / F.lit(BLOCK)).alias("block")).agg(ids.alias("ids"))
    return blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").mapInArrow(_digests, "depth long, fa long, fb long, ends_sha256 string")


def _attempt(hashed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(members, nodes, conversations), or None where two different prefixes have one product.

    A prefix is known by its parent and its last turn. If these agree for all members of each product at each depth, then
    by induction from the root equal products stand for equal sequences of turns.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("prefix"), F.col("ha"), F.col("hb")]
    slim = hashed.select("conv_id", "ha", "hb", F.char_length("text").cast("long").alias("chars"), "turn", "role", F.substring("text", 1, ORDER_CHARS).alias("prefix"))
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "ha", "hb", "chars", F.spark_partition_id().alias("part"))
    turns = freeze(dealt.mapInArrow(_running(BASES), "conv_id long, ha long, hb long, chars long, part int, at long, fa long, fb long, pa long, pb long, upto long"), "turns")
    runs = freeze(_runs(turns), "runs")
    convs = _conversations(runs)
    members = _members(turns, runs, convs)
    checked = ("pa", "pb", "ha", "hb")
    sums = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("before").alias("before")]
    nodes = freeze(members.groupBy(*_KEY).agg(*sums, *[F.min(c).alias(c) for c in checked], *[F.max(c).alias(f"{c}_") for c in checked]), "nodes")
    release(turns, runs)
    if not nodes.where(" or ".join(f"{c} <> {c}_" for c in checked)).isEmpty():
        release(members, nodes, convs)
        return None
    return members, nodes.drop(*[f"{c}_" for c in checked]), convs


def prefix_nodes(conversations: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Each distinct prefix of the rebuilt conversations, from the root, with its counts and the digest of those that end there.

    Turns are hashed where they are read; conversations are products of turn hashes. The product of a rebuilt
    conversation's prefix is the other conversation's head product combined with a stretch of its own, so no text is
    copied or put together. Hashes of turns are checked against the texts, products against parents and last turns; if any
    clash, all is done again under another seed.

    Turns of one number are in order of role, then of the text's first ORDER_CHARS characters, then of its hash. Null roles and texts
    are empty, null turns come first; rows without a conv_id belong to no conversation and are left out. An empty table
    has no conversations, so no root. A conversation of any length is spread over tasks by ranges of its turns.
    """
    for seed in range(SEEDS):
        hashed = _hashed(conversations, seed, hash_bits)
        if not _clashing(hashed) and (found := _attempt(hashed)) is not None:
            return _with_subtrees(*found)
    raise RuntimeError(f"hashes of {hash_bits} bits clash under {SEEDS} seeds")


def _with_subtrees(members: DataFrame, nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """Sums over subtrees without walking them: each member of a node adds what its own way below the node is worth.

    A node's conv_id is its smallest member. The nodes with one conv_id are a stretch of that conversation's way
    to its end, from the depth where it first is the smallest. So characters of distinct nodes below a node are those of
    its members from there on, and what is saved is what members have before, from the node's depth on. Each
    childless node counts once, for its smallest member.
    """
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = freeze(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "with_children")
    smallest = nodes.groupBy("conv_id").agg(F.min("before").alias("shared"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    per_conv = convs.select("conv_id", "depths", "all_chars").join(smallest.hint("merge"), "conv_id", "left")
    per_conv = per_conv.select(F.col("conv_id").alias("_conv"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("depths") / BLOCK))).alias("_block"), F.coalesce("shared", "all_chars").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    met = members.select("conv_id", *_KEY, "before").join(per_conv.hint("merge"), (F.col("conv_id") == F.col("_conv")) & (F.floor(F.col("depth") / BLOCK) == F.col("_block")))
    sums = met.groupBy(*_KEY).agg(F.sum("leaf").cast("long").alias("n_leaves"), F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).cast("long").alias("saved_tokens"))
    rows = nodes.join(sums, _KEY).join(_ends(members), _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    many = F.col("n_children") > max(1, int(nodes.count() * HOT_SHARE))
    up = lambda rows, own: rows.select(F.col("depth").alias("_d"), F.col("fa").alias("_a"), F.col("fb").alias("_b"), F.col("conv_id").alias(own))
    rows = rows.join(F.broadcast(up(nodes.where(many), "_hot")), (F.col("depth") - 1 == F.col("_d")) & (F.col("pa") == F.col("_a")) & (F.col("pb") == F.col("_b")), "left").drop("_d", "_a", "_b")
    found = F.col("_hot").isNotNull()
    rows = rows.withColumns({"_depth": F.when(found, -1).otherwise(F.col("depth") - 1), "_pa": F.when(found, F.col("fa")).otherwise(F.col("pa")), "_pb": F.when(found, F.col("fb")).otherwise(F.col("pb"))})  # those that have theirs are spread by their own keys
    rows = rows.join(up(nodes.where(~many & (F.col("n_children") > 0)), "_parent"), (F.col("_depth") == F.col("_d")) & (F.col("_pa") == F.col("_a")) & (F.col("_pb") == F.col("_b")), "left")
    return rows.select("conv_id", "depth", F.coalesce("_hot", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
