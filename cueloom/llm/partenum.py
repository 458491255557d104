"""Jaccard join of word shingles with PartEnum signatures, and the components of its links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze, release
from cueloom.llm.columns import every, set_aside
from cueloom.llm.components import components
from cueloom.llm.idfilter import with_ids
from cueloom.llm.textscan import mix, shingles, slices

WIDTH = 5
#: Similarity as a fraction: two sets link when DENOMINATOR * intersection >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 80, 100
#: First-level parts of the feature domain are cut into so many second-level parts, and all subsets that leave out so many are signed.
SECOND, LEFT_OUT = 3, 1
#: A set with more empty signatures than a scheme allows for also signs with the next seed, up to so many.
MAX_SEEDS = 8
#: Classes of features whose counts outline a set: outlines that differ too much rule a pair out before its sets meet.
OUTLINE = 256
#: Ids up to which they (8 bytes each) are broadcast to pick their texts; beyond, filters of them do it in the scan.
BROADCAST_IDS = 200_000
#: Features whose signatures a task holds before it hands them on, and those of how many sets at most.
HELD = 500_000
HELD_SETS = 1 << 16
#: So many keys of one signature are handed on as one row.
TOGETHER = 4
#: Of the features of all sets, so many eighths are looked up first; the sets that are left then look up all of theirs.
PROBED = 4
#: Signatures are dealt to as many ranges as there are shuffle partitions, within these bounds.
LEAST_RANGES, MOST_RANGES = 64, 1 << 16
#: Labels that unequal texts may share by chance (none is expected below 10**10 texts) before the join gives up.
MAX_CLASHES = 1_000_000


@cache
def edges(i: int) -> tuple[int, int]:
    """Least and largest size in size band i: each holds the sizes up to 1 / similarity times its least."""
    low = 1 if i == 0 else edges(i - 1)[1] + 1
    return low, max(low, low * DENOMINATOR // NUMERATOR)


def band(size: int) -> int:
    """The band of a size."""
    i = 0
    while edges(i)[1] < size:
        i += 1
    return i


@cache
def most_differing(i: int) -> int:
    """How many features linked sets can differ in, if the smaller one is in band i."""
    high = edges(i)[1]
    return (high + high * DENOMINATOR // NUMERATOR) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def _below(p: float, n: int, e: int) -> float:
    """Chance of at most e successes in n trials."""
    term = total = (1 - p) ** n
    for x in range(e):
        term *= (n - x) / (x + 1) * p / (1 - p)
        total += term
    return total


@cache
def scheme(i: int) -> tuple[int, int, int, int]:
    """(first-level parts, second-level parts of each, second-level parts left out, first-level parts that may have an empty signature).

    Linked sets whose smaller one is in band i differ in at most k features. So of k // (o + 1) + 1 + e first-level
    parts, at least 1 + e hold at most o differing features, and in each of those some subset that leaves out o
    second-level parts agrees. One of these agreeing signatures is not empty if, in either set, at most e parts have
    an empty one. e is chosen for the fewest signatures, counting the further seeds that sets with more must sign.
    """
    k = most_differing(i)
    if not k:
        return 1, 1, 0, 0
    second, out = SECOND, LEFT_OUT
    subsets, low, best = math.comb(second, out), edges(i)[0], None
    for e in range(k + 8):
        first = k // (out + 1) + 1 + e
        if best and first * subsets > best[0]:
            break
        empty = min(1.0, subsets * (1 - (second - out) / (second * first)) ** (low * 1.1)) if first > 1 or e else 0.0
        fine = _below(empty, first, e) if empty < 1 else 0.0
        if fine > 0.5 and (best is None or first * subsets / fine < best[0]):
            best = (first * subsets / fine, first, e)
    _, first, e = best or (0, k // (out + 1) + 1, 0)
    return first, second, out, e


def _sum_of(values: np.ndarray, chosen: list[list[int]]) -> np.ndarray:
    """For each choice of places on the last axis, the sum of the values there."""
    total = np.zeros((*values.shape[:-1], len(chosen)), values.dtype)
    for n, places in enumerate(chosen):
        for at in places:
            total[..., n] += values[..., at]
    return total


def _sign(sets: list[np.ndarray], i: int, seed: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, set of each, sets with more empty ones than allowed) under the scheme of band i and one seed; empty ones only if last."""
    first, second, out, spare = scheme(i)
    sizes, parts = np.array([len(f) for f in sets]), first * second
    doc = np.repeat(np.arange(len(sets)), sizes)
    f = np.concatenate(sets)
    if seed:
        f = mix(f + np.uint64(seed))
        f = f[np.lexsort((f, doc))]
    place = doc * parts + (((f >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    sums, counts = np.zeros(len(sets) * parts, np.uint64), np.zeros(len(sets) * parts, np.int64)
    sums[place[begins]] = np.add.reduceat(mix(f ^ np.uint64(0x5851F42D4C957F2D)), begins)
    counts[place[begins]] = np.diff(np.append(begins, len(f)))
    sums, counts = sums.reshape(-1, first, second), counts.reshape(-1, first, second)
    left_out = [list(c) for c in combinations(range(second), out)]
    sums, counts = (x.sum(axis=2, dtype=x.dtype)[:, :, None] - _sum_of(x, left_out) for x in (sums, counts))
    number = np.arange(first * len(left_out), dtype=np.uint64).reshape(first, len(left_out))
    tag = np.uint64((i * MAX_SEEDS + seed) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF)
    found = mix(sums ^ mix(number + tag))
    filled = counts > 0
    signed = filled | last
    return found[signed], np.nonzero(signed)[0], np.flatnonzero((~filled).any(axis=2).sum(axis=1) > spare)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the set of each) of sets of sorted distinct 64-bit features, none of them empty.

    A set signs under its own band, and under the band below if a linked set can lie there. If too many signatures
    are empty, agreeing ones may all be: the set then signs under further seeds, which its equals do too, and with
    the last seed it signs its empty subsets as well.
    """
    bands: dict[int, list[int]] = {}
    for n, f in enumerate(sets):
        own = band(len(f))
        bands.setdefault(own, []).append(n)
        if own and edges(own - 1)[1] * DENOMINATOR >= len(f) * NUMERATOR:
            bands.setdefault(own - 1, []).append(n)
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, members in bands.items():
        left = np.array(members)
        for seed in range(MAX_SEEDS):
            found, which, again = _sign([sets[n] for n in left], i, seed, seed == MAX_SEEDS - 1)
            sigs.append(found)
            owners.append(left[which])
            left = left[again]
            if not len(left):
                break
    return np.concatenate(sigs), np.concatenate(owners)


def _halves(words: np.ndarray) -> tuple[int, int]:
    raw = blake2b(words.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _key(words: np.ndarray, clashing: frozenset[int]) -> tuple[int, int]:
    """(key, check) of a sequence of words: the halves of its 128-bit hash, the other way round if the first half belongs to several texts."""
    key, check = _halves(words)
    return (check, key) if key in clashing else (key, check)


def _sets(texts: pa.Array, clashing: frozenset[int]) -> Iterator[tuple[int, tuple[int, int], np.ndarray]]:
    """(row, (key, check) of the word sequence, sorted distinct shingles) of each text."""
    for s in slices(texts):
        words = s.word_hashes(lower=True)
        for r in range(len(s)):
            own = words[s.bounds[r] : s.bounds[r + 1]]
            features = np.sort(shingles(own, WIDTH))
            features = features[np.flatnonzero(np.concatenate([[True], features[1:] != features[:-1]]))] if len(features) else features
            yield s.first + r, _key(own, clashing), features


_SIGNED = "range int, sigs array<int>, many array<int>, keys array<long>, sig long"
_LOOKED_UP = "range int, sigs array<int>, many array<int>, keys array<long>, counts array<long>, ids array<long>, checks array<long>, sizes array<long>"


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _split(sigs: np.ndarray, owners: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted signatures cut to their range and the next 32 bits, owners of each, where each different one begins)."""
    spare = np.uint64(32 - (ranges - 1).bit_length())
    both = np.sort(sigs >> spare << spare | owners.astype(np.uint64))
    held, owner = both >> spare, (both & ((np.uint64(1) << spare) - np.uint64(1))).astype(np.int64)
    return held, owner, np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)


def _dealt(schema: str, held: np.ndarray, owner: np.ndarray, keys: np.ndarray, ranges: int) -> pa.RecordBatch:
    """One row per range with the signatures in it, 4 bytes each, and their owners' keys in order."""
    bits = np.uint64((ranges - 1).bit_length())
    spare, half = np.uint64(32) - bits, np.uint64(32)
    both = np.sort(held >> half << (np.uint64(64) - bits) | owner.astype(np.uint64) << half | held & np.uint64(0xFFFFFFFF))
    run = both >> half  # the range and the owner
    runs = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    place, owner = run[runs] >> spare, (run[runs] & ((np.uint64(1) << spare) - np.uint64(1))).astype(np.int64)
    rows = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(runs) else np.zeros(0, np.int64)
    return _batch(
        schema, len(rows), range=pa.array(place[rows].astype(np.int32)), sigs=_lists((both & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), np.append(runs[rows], len(both)), pa.int32()),
        many=_lists(np.diff(np.append(runs, len(both))).astype(np.int32), np.append(rows, len(runs)), pa.int32()), keys=_lists(keys[owner], np.append(rows, len(runs)), pa.int64()),
    )


def _handed_on(sigs: np.ndarray, owners: np.ndarray, keys: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows of _SIGNED from signatures and the keys of their owners (numbers below HELD_SETS).

    A signature of many keys is one row with all of them, dealt by its first key, and only that key stands for it in
    its range: so a signature that a third of all sets share comes to its range once a batch.
    """
    held, owner, begins = _split(sigs, owners, ranges)
    sizes = np.diff(np.append(begins, len(held)))
    large = sizes >= TOGETHER
    if large.any():
        inside, first = np.repeat(large, sizes), keys[owner[begins[large]]]
        deal = pa.array((first.view(np.uint64) % np.uint64(ranges)).astype(np.int32))
        lists = _lists(keys[owner[inside]], np.concatenate([[0], np.cumsum(sizes[large])]), pa.int64())
        yield _batch(_SIGNED, len(first), range=deal, keys=lists, sig=pa.array(held[begins[large]].view(np.int64)))
        inside[begins[large]] = False
        held, owner = held[~inside], owner[~inside]
    yield _dealt(_SIGNED, held, owner, keys, ranges)


def _looked_up(sets: list[np.ndarray], keys: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows of _LOOKED_UP from features: those that several of the sets have are counted for each at once, and only told to their range, without a key."""
    owners = np.repeat(np.arange(len(sets)), [len(f) for f in sets])
    held, owner, begins = _split(np.concatenate(sets), owners, ranges)
    sizes = np.diff(np.append(begins, len(held)))
    inside = np.repeat(sizes > 1, sizes)
    counts = np.bincount(owner[inside], minlength=len(sets))
    some = np.flatnonzero(counts)
    deal = pa.array([int(keys[0]) % ranges], pa.int32())
    yield _batch(_LOOKED_UP, 1, range=deal, keys=_lists(keys[some], np.array([0, len(some)]), pa.int64()), counts=_lists(counts[some], np.array([0, len(some)]), pa.int64()))
    yield _dealt(_LOOKED_UP, held[~inside], owner[~inside], keys, ranges)
    told = held[begins[sizes > 1]]
    place = told >> np.uint64(32)
    rows = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(told) else np.zeros(0, np.int64)
    yield _batch(_LOOKED_UP, len(rows), range=pa.array(place[rows].astype(np.int32)), sigs=_lists((told & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), np.append(rows, len(told)), pa.int32()))


def _batch(schema: str, n: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, kinds[k])) for c, k in names], names=[c for c, _ in names])


def _read(ranges: int, clashing: frozenset[int]):
    """Rows of _LOOKED_UP from (doc_id, text): the documents with keys, checks and set sizes, and the features of each key new to the task.

    Only PROBED eighths of the features are looked up. ``counts`` tells how many of a document's features those are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        info: list[tuple] = []
        held: list[np.ndarray] = []
        keys: list[int] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            bounds = np.array([0, len(info)])
            columns = {c: _lists(pa.array(list(v), pa.int64()), bounds, pa.int64()) for c, v in zip(("ids", "keys", "checks", "sizes", "counts"), zip(*info, strict=True), strict=True)}
            yield _batch(_LOOKED_UP, 1, range=pa.array([info[0][1] % ranges], pa.int32()), **columns)
            if held:
                yield from _looked_up(held, np.array(keys, np.int64), ranges)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, (key, check), features in _sets(batch.column(1), clashing):
                probed = features[features & np.uint64(7) < PROBED]
                info.append((ids[row], key, check, len(features), len(probed)))
                if len(probed) and key not in known:
                    if len(known) > HELD:
                        known.clear()
                    known.add(key)
                    held.append(probed)
                    keys.append(key)
                    size += len(probed)
                if size > HELD or len(info) == HELD_SETS:
                    yield from flush()
                    info, held, keys, size = [], [], [], 0
        if info:
            yield from flush()

    return run


def _of_sets(step):
    """Run step(sets, keys) over (key, features), so many sets at a time that it holds no more than some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = np.array(batch.column(0)), batch.column(1)
            bounds, values = np.array(lists.offsets), np.array(lists.values).view(np.uint64)
            begin = 0
            while begin < len(keys):
                end = min(begin + HELD_SETS, max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + HELD // 4, "right")) - 1))
                yield from step([values[a:b] for a, b in zip(bounds[begin:end], bounds[begin + 1 : end + 1], strict=True)], keys[begin:end])
                begin = end

    return run


_SHARED = "key long, shared long, doc_id long, check long, n long"


def _flat(group: pa.Table, column: str) -> np.ndarray:
    return np.array(group[column].combine_chunks().flatten())


def _runs(sigs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(32-bit signatures in order, their keys, where each different one begins)."""
    both = np.sort(sigs.astype(np.uint64) << np.uint64(32) | np.arange(len(sigs), dtype=np.uint64))
    sigs, keys = both >> np.uint64(32), keys[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    return sigs, keys, np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1]])) if len(sigs) else np.zeros(0, np.int64)


def _share(group: pa.Table) -> pa.Table:
    """Of one range: the documents, with how many features were looked up as shared, and (key, shared): how many features of a set others have, at least."""
    names, parts = [c.split(" ")[0] for c in _SHARED.split(", ")], []
    has = {c: pc.is_valid(group[c]) for c in ("ids", "counts", "keys")}
    some = group.filter(has["ids"])
    if len(some):
        ids = some["ids"].combine_chunks().flatten()
        parts.append([pa.array(_flat(some, "keys")), pa.array(_flat(some, "counts")), ids, pa.array(_flat(some, "checks")), pa.array(_flat(some, "sizes"))])
    some = group.filter(pc.and_(has["counts"], pc.invert(has["ids"])))
    counted = [(_flat(some, "keys"), _flat(some, "counts"))] if len(some) else []
    rest = group.filter(pc.invert(has["counts"]))
    single, told = rest.filter(pc.is_valid(rest["keys"])), rest.filter(pc.invert(pc.is_valid(rest["keys"])))
    if len(single):
        sigs, keys, begins = _runs(_flat(single, "sigs").view(np.uint32), np.repeat(_flat(single, "keys"), _flat(single, "many")))
        shared = np.minimum.reduceat(keys, begins) != np.maximum.reduceat(keys, begins)
        if len(told):
            shared |= np.isin(sigs[begins], _flat(told, "sigs").view(np.uint32).astype(np.uint64))
        inside = np.repeat(shared, np.diff(np.append(begins, len(sigs))))
        counted.append(np.unique(keys[inside], return_counts=True))
    for keys, counts in counted:
        empty = pa.nulls(len(keys), pa.int64())
        parts.append([pa.array(keys), pa.array(counts.astype(np.int64)), empty, empty, empty])
    empty = pa.array([], pa.int64())
    return pa.concat_tables([pa.Table.from_arrays(p, names=names) for p in parts or [[empty] * 5]])


_MET = "sig long, key long"


def _meet(group: pa.Table) -> pa.Table:
    """Of one range: (sig, key) of the signatures that several keys share."""
    whole = pc.is_valid(group["sig"])
    found, some = [], group.filter(whole)
    if len(some):
        found.append((np.repeat(np.array(some["sig"]), np.array(pc.list_value_length(some["keys"]))), _flat(some, "keys")))
    some = group.filter(pc.invert(whole))
    if len(some):
        sigs, keys, begins = _runs(_flat(some, "sigs").view(np.uint32), np.repeat(_flat(some, "keys"), _flat(some, "many")))
        shared = np.minimum.reduceat(keys, begins) != np.maximum.reduceat(keys, begins) if len(begins) else np.zeros(0, bool)
        inside = np.repeat(shared, np.diff(np.append(begins, len(sigs))))
        found.append((sigs[inside].astype(np.int64) | np.int64(group["range"][0].as_py()) << np.int64(32), keys[inside]))
    return pa.Table.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in (0, 1)], names=["sig", "key"])


def _ranges_of(df: DataFrame) -> int:
    """How many ranges signatures are dealt to, a power of two."""
    return min(MOST_RANGES, 1 << (max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length())


def _shingled(clashing: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, arrays, total = [], [], 0
            for _, (key, _), features in _sets(batch.column(0), clashing):
                keys.append(key)
                arrays.append(features)
                total += len(features)
                if total > HELD:
                    yield _listed(keys, arrays)
                    keys, arrays, total = [], [], 0
            if keys:
                yield _listed(keys, arrays)

    return run


def _listed(keys: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(a) for a in arrays])
    counts = np.concatenate([np.minimum(np.bincount((a & np.uint64(OUTLINE - 1)).astype(np.int64), minlength=OUTLINE), 127).astype(np.int8) for a in arrays])
    outlines = _lists(counts, np.arange(len(arrays) + 1) * OUTLINE, pa.int8())
    features = _lists(np.concatenate(arrays).view(np.int64), np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes.astype(np.int64)), outlines, features], names=["key", "size", "outline", "features"])


_NO_ID = -(1 << 63)


def _sets_of(docs: DataFrame, info: DataFrame, keys: DataFrame, clashing: frozenset[int]) -> tuple[DataFrame, DataFrame]:
    """(key, size, features) and (key, size, outline) of the keys, written, each read from one of its documents. Beyond BROADCAST_IDS filters of the ids part the texts in the scan."""
    ids = info.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("_id")).select("_id").distinct()
    ids = freeze(ids, "representatives", few=True)
    texts = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"))
    if ids.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "_id", "left_semi")
    else:
        texts = with_ids(texts, F.col("_id"), ids, info.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_id")), inside=True)
    texts = texts.select("text")
    sets = freeze(texts.mapInArrow(_shingled(clashing), "key long, size long, outline array<byte>, features array<long>"), "sets")
    release(ids)
    return sets, freeze(sets.select("key", "size", "outline"), "outlines", few=True)


def _of_pairs(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the sizes and a column of both their sets. Only sets that some pair names are shuffled, while their keys are few enough to broadcast."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    named = table.select("key", "size", column)
    if pairs.count() <= BROADCAST_IDS // 2:
        named = named.join(F.broadcast(keys), "key", "left_semi")
    left, right = (named.select(F.col("key").alias(c), F.col("size").alias(f"size_{c}"), F.col(column).alias(f"_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b")


def _verify(pairs: DataFrame, sets: DataFrame, outlines: DataFrame) -> DataFrame:
    """Of a written table of candidate pairs (a, b) of keys, those whose sets are similar enough.

    Two sets differ in at least as many features as their outlines' counts do, which rules most pairs out; the
    sets of the others are intersected whole.
    """
    apart = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda n, x: n + x)
    near = _of_pairs(pairs, outlines, "outline").where(apart * (NUMERATOR + DENOMINATOR) <= (F.col("size_a") + F.col("size_b")) * (DENOMINATOR - NUMERATOR))
    near = freeze(near.select("a", "b"), "near", few=True)
    both = _of_pairs(near, sets, "features").withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    found = freeze(both.where(DENOMINATOR * F.col("_both") >= NUMERATOR * (F.col("size_a") + F.col("size_b") - F.col("_both"))).select("a", "b").distinct(), "links", few=True)
    release(near)
    return found


def _looked_up_docs(docs: DataFrame, ranges: int) -> tuple[DataFrame, frozenset[int]]:
    """The written rows of _SHARED of all documents, and the keys that several texts had, which is told by their checks: all are read again without those."""
    texts, clashing = docs.select(F.col("doc_id").cast("long"), "text"), frozenset()
    while True:
        met = freeze(texts.mapInArrow(_read(ranges, clashing), _LOOKED_UP).groupBy("range").applyInArrow(_share, _SHARED), "shared")
        checks = met.where("n is not null").groupBy("key").agg(F.min("check").alias("_low"), F.max("check").alias("_high"))
        more = checks.where("_low <> _high").select("key").limit(MAX_CLASHES + 1).collect()
        if not more:
            return met, clashing
        if clashing or len(more) > MAX_CLASHES:
            raise RuntimeError("too many unequal texts have one 64-bit hash")
        release(met)
        clashing = frozenset(r["key"] for r in more)


def _can_link(alone: Column, n: Column) -> Column:
    """Whether a set of n features, alone of which no other set has, can link with any: with a set of its others, nothing more."""
    return DENOMINATOR * alone <= (DENOMINATOR - NUMERATOR) * n


def _members(sets: DataFrame, keys: DataFrame, ranges: int) -> DataFrame:
    """(sig, key, alone, n) of the shared signatures of keys (key, alone, n), without those of a signature that can link with no other at it.

    Linked sets of n and m features share at least N / (N + D) of n + m, and no feature that one has alone; so a set
    is left out where even the smallest set at its signature is too large for what it can share.
    """
    own = sets.join(keys.select("key"), "key", "left_semi").select("key", "features")
    sign = lambda some, k: _handed_on(*signatures(some), k, ranges)
    met = own.mapInArrow(_of_sets(sign), _SIGNED).groupBy("range").applyInArrow(_meet, _MET).distinct()
    met = freeze(met.join(keys, "key"), "signatures")
    least = met.groupBy("sig").agg(F.min("n").alias("_least"))
    able = met.join(least, "sig").where((NUMERATOR + DENOMINATOR) * (F.col("n") - F.col("alone")) >= NUMERATOR * (F.col("n") + F.col("_least"))).drop("_least")
    members = freeze(able, "members")
    release(met)
    return members


def _groups(members: DataFrame, keys: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, key, both, n, alone): every key with the pivot of each of its signatures, itself one or not, and how many features they share.

    A signature's pivot is the key with the smallest share of features alone: the nearest to what others are copies of.
    """
    pivots = members.groupBy("sig").agg(F.min_by("key", F.struct(F.col("alone") / F.col("n"), "key")).alias("pivot"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    pairs = freeze(members.join(pivots, "sig").select("pivot", "key").distinct(), "pivots", few=True)
    both = _of_pairs(pairs.where("pivot <> key").select(F.col("pivot").alias("a"), F.col("key").alias("b")), sets, "features")
    both = both.select(F.col("a").alias("pivot"), F.col("b").alias("key"), F.size(F.array_intersect("_a", "_b")).alias("both")).distinct()
    own = pairs.where("pivot = key").join(keys.select("key", F.col("n").cast("int").alias("both")), "key").select("pivot", "key", "both")
    return freeze(both.unionByName(own).join(keys, "key").select("pivot", "key", "both", "n", "alone"), "groups", few=True)


def _across(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys that have a pivot in common, are in different components and share enough as far as the pivot can tell.

    What x and y share lies in the pivot, where it is no more than either shares with that, or outside of it, where
    it is no more than either has there and not alone.
    """
    g = groups.join(comps, groups["key"] == comps["node"], "left").select("pivot", "key", "both", "n", F.coalesce("comp", "key").alias("comp"), F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("both") - F.col("alone")).alias("rest"))
    a, b = (g.select("pivot", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "both", "n", "comp", "rest")]) for x in "ab")
    most = F.least("both_a", "both_b") + F.least("rest_a", "rest_b")
    may = (NUMERATOR + DENOMINATOR) * most >= NUMERATOR * (F.col("n_a") + F.col("n_b"))
    return a.join(b, "pivot").where((F.col("key_a") < F.col("key_b")) & (F.col("comp_a") != F.col("comp_b")) & may).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(info, comps, clashing): for each document its key and set size, for each linked key its component, and the keys that are second halves.

    1. Features that no other set has are counted: a set with more than a fifth of such can link with nothing and is
       left out. Half of the features, looked up for all sets, tell most of them; the sets that are left look up all.
    2. The others sign subsets of parts; signatures that sets with different keys share are kept, with their keys.
    3. Keys are compared with the pivot of each of their signatures.
    4. Keys that have a pivot in common and are still in different components are compared, unless what each shares
       with the pivot, and has alone, tells that they cannot link.
    Every linked pair shares a signature, and so a pivot; so it is compared or found connected, and the components
    are those of all links.
    """
    ranges = _ranges_of(docs)
    met, clashing = _looked_up_docs(docs, ranges)
    info = met.where("n is not null").select("doc_id", "key", "n")
    none = F.lit(0).cast("long")
    own = met.groupBy("key").agg(F.max("n").alias("n"), F.max(F.when(F.col("n").isNotNull(), F.col("shared"))).alias("_probed"), F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("shared"))), F.lit(0)).alias("_shared"))
    maybe = own.where("n > 0").where(_can_link(F.greatest(none, F.col("_probed") - F.col("_shared")), F.col("n")))
    maybe = freeze(maybe.select("key", "n"), "maybe", few=True)
    sets, outlines = _sets_of(docs, info, maybe, clashing)
    look = lambda some, k: _looked_up(some, k, ranges)
    again = sets.join(maybe, "key", "left_semi").select("key", "features").mapInArrow(_of_sets(look), _LOOKED_UP).groupBy("range").applyInArrow(_share, _SHARED)
    again = maybe.join(again.groupBy("key").agg(F.sum("shared").alias("_shared")), "key").withColumn("alone", F.greatest(none, F.col("n") - F.col("_shared")))
    keys = freeze(again.where(_can_link(F.col("alone"), F.col("n"))).select("key", "alone", "n"), "keys", few=True)
    members = _members(sets, keys, ranges)
    groups = _groups(members, keys, sets)
    found = groups.where("pivot <> key").join(keys.select(F.col("key").alias("pivot"), F.col("n").alias("_m")), "pivot").where((NUMERATOR + DENOMINATOR) * F.col("both") >= NUMERATOR * (F.col("n") + F.col("_m")))
    found = freeze(found.select(F.col("pivot").alias("a"), F.col("key").alias("b")), "links", few=True)
    comps = components(found)
    pairs = freeze(_across(groups, comps).distinct(), "candidates", few=True)
    if not pairs.isEmpty():
        more = _verify(pairs, sets, outlines)
        if not more.isEmpty():
            release(comps)
            comps = components(found.unionByName(more))
    release(sets, outlines, maybe, members, groups)
    return info, comps, clashing


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and component_size.

    A set has the distinct runs of five words (letters A to Z in lower case), or the whole of a shorter text; an
    empty or null text has none and links with nothing, so it is its own component. Equal texts are one key from
    the start and always link. Texts are told apart by 128-bit hashes, shingles by 64-bit ones. doc_id must be a
    whole number; a null one counts as larger than all others; rows that repeat a doc_id with another text keep
    their own sets and components.
    """
    info, comps, _ = links(docs)
    keyed = info.groupBy("key").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows"), F.max("n").alias("_n"))
    keyed = keyed.join(comps, keyed["key"] == comps["node"], "left").select("key", F.coalesce("comp", "key").alias("_comp"), "_first", "_rows", "_n")
    groups = keyed.groupBy("_comp").agg(F.min("_first").alias("component_id"), F.sum("_rows").alias("component_size"))
    labels = keyed.join(groups, "_comp").select("key", "component_id", "component_size")
    empty = F.col("n") == 0
    named = info.where("n > 0").join(labels, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "component_size")
    alone = info.where(empty).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("component_size"))
    return named.unionByName(alone)


def _keyed(clashing: frozenset[int]):
    """Append to rows whose last column is the text: the key of its word sequence, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(batch.num_columns - 1)):
                words = s.word_hashes(lower=True)
                own = [words[a:b] for a, b in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
                keys = pa.array([_key(w, clashing)[0] if len(w) else None for w in own], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s.first, len(s)) for c in range(batch.num_columns)), keys], names=[*batch.schema.names, "_key"])

    return run


def _winners(info: DataFrame, comps: DataFrame) -> DataFrame:
    """(doc_id, key): of each component the smallest doc_id with the smallest key it has there, and the smallest key without a doc_id."""
    keyed = info.where("n > 0").groupBy("key", F.col("doc_id").isNull().alias("_nameless")).agg(F.min("doc_id").alias("_first"))
    keyed = keyed.join(comps, keyed["key"] == comps["node"], "left").select("key", F.coalesce("comp", "key").alias("_comp"), "_nameless", "_first")
    return keyed.groupBy("_comp", "_nameless").agg(F.min(F.struct("_first", "key")).alias("_w")).select(F.col("_w._first").alias("doc_id"), "_w.key")


def _by_ids(docs: DataFrame, ids: DataFrame, known: DataFrame, inside: bool) -> DataFrame:
    """The rows of docs whose doc_id is among ids (a written table), or those where it is not, without shuffling them."""
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi" if inside else "left_anti").select(*every(docs))
    return with_ids(docs, F.col("doc_id").cast("long"), ids.select(F.col("doc_id").cast("long").alias("_id")), known.select(F.col("_id").cast("long").alias("_id")), inside)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component, one row with the smallest doc_id stays.

    Texts without words all stay. Where a doc_id stands on several rows, each row is told by its doc_id and the key
    of its words, so a row goes only if its own text is a near copy; of those of one component the one with the
    smallest key, then text, stays. Rows without a doc_id give way to each other, not to rows with one.
    """
    info, comps, clashing = links(docs)
    winners = freeze(_winners(info, comps), "winners", few=True)
    named = info.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.min("key").alias("key"), F.max("n").alias("n"))
    named = freeze(named, "named", few=True)
    dropped = freeze(named.where("_rows = 1 and n > 0").join(winners, ["doc_id", "key"], "left_anti").select("doc_id"), "dropped", few=True)
    known = named.select(F.col("doc_id").alias("_id"))
    kept = _by_ids(docs, dropped, known, inside=False)
    repeated = freeze(named.where("_rows > 1").select("doc_id"), "repeated", few=True)
    n_repeated = repeated.count()
    if not n_repeated and info.where("doc_id is null").isEmpty():
        return kept
    plain = _by_ids(kept.where("doc_id is not null"), repeated, known, inside=False)
    odd = docs.where("doc_id is null").unionByName(_by_ids(docs, repeated, known, inside=True))
    names = [f"_k{i}" for i in range(len(docs.columns))]
    odd = odd.select(F.col("doc_id").alias("_id"), *set_aside(docs)[0], F.col("text").alias("_text"))
    odd = odd.mapInArrow(_keyed(clashing), ", ".join(f"`{n}` {t}" for n, t in odd.dtypes) + ", _key long")
    won = winners.select(F.col("doc_id").alias("_won"), F.col("key").alias("_won_key"))
    first = Window.partitionBy("_id", "_key").orderBy("_text")
    once = odd.where("_key is not null").join(won, (F.col("_key") == F.col("_won_key")) & F.col("_id").eqNullSafe(F.col("_won")), "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    odd = odd.where("_key is null").unionByName(once)
    return plain.unionByName(odd.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]))
