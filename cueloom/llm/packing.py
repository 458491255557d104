"""Best-fit packing of tokenised documents into sequences, improved by a grouping genetic algorithm on islands."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.llm.textscan import Slice, slices

CAPACITY = 4096
END_ID = 1
#: About so many pieces are packed together; each such shard is solved on ISLANDS islands.
SHARD_PIECES = 4000
ISLANDS = 3
#: Stages of evolution; after each, every island's best solution also moves to the next island of its shard.
EPOCHS = 2
POPULATION = 8
GENERATIONS = 40
#: Bins filled less than this share are opened again and packed together across shards, until one shard is left or so many times.
WELL_FILLED = 0.97
REPACKS = 3
#: Parts of words whose ids a worker remembers (about 25 bytes each); longer ones than PART_BYTES are tokenised wherever they stand.
REMEMBERED = 1_000_000
PART_BYTES = 64
#: New parts are tokenised so many at a time.
TOGETHER = 2000

_PLAIN, _MARK, _LETTER = (np.zeros(256, bool) for _ in range(3))
_PLAIN[97:123] = True
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = ~_LETTER[33:127]


def _parts(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether it must stand alone) of the parts of a slice's words that are tokenised apart.

    The tokenizer cuts at white space, and before a run of marks. So marks at the end of a word (after a letter or
    digit that is one for sure) are a part of their own, which leaves far fewer different parts. A word that may
    hold a special token stays whole and is never remembered, as its case matters; nor is a very long part.
    """
    d, starts, ends = s.data, s.starts, s.ends
    solid = np.maximum.accumulate(np.where(_MARK[d], -1, np.arange(len(d))))[ends - 1] + 1 if len(starts) else ends
    last = d[solid - 1]
    latin = (solid - starts >= 2) & (d[solid - 2] == 0xC3) & ~np.isin(last, (0x97, 0xB7))
    cut = (solid > starts) & (solid < ends) & (_LETTER[last] | latin)
    special = np.zeros(len(starts), bool)
    special[np.searchsorted(starts, np.flatnonzero((d[:-1] == 60) & (d[1:] == 124)), "right") - 1] = True
    cut &= ~special
    at = np.flatnonzero(cut) + 1
    starts, ends, special = np.insert(starts, at, solid[cut]), np.insert(np.where(cut, solid, ends), at, ends[cut]), np.insert(special, at, False)
    return starts, ends, special | (ends - starts > PART_BYTES)


class WordIds:
    """Token ids of whole texts: those of the texts' parts, of which the ones seen lately are remembered in flat arrays of a bounded size."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _tokenised(self, parts: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and the ids of all in order. Plain parts, of a to z alone, need only the tokenizer's model."""
        own: list[list[int]] = [[]] * len(parts)
        model = self.tokenizer.model
        for n in np.flatnonzero(plain).tolist():
            own[n] = [t.id for t in model.tokenize(parts[n])]
        rest = np.flatnonzero(~plain).tolist()
        for i in range(0, len(rest), TOGETHER):
            some = [parts[n] for n in rest[i : i + TOGETHER]]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum([len(w) + 1 for w in some])
            cuts = np.searchsorted(np.array([o[0] for o in e.offsets], np.int64), begins).tolist()
            ids = e.ids
            for n, a, b in zip(rest[i : i + TOGETHER], [0, *cuts[:-1]], cuts, strict=True):
                own[n] = ids[a:b]
        return np.fromiter(map(len, own), np.int64, len(own)), np.fromiter(chain.from_iterable(own), np.uint32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted hashes stand among the remembered ones, and whether they do."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def of(self, s: Slice, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a slice, each row's followed by the end id, and where each row begins."""
        data = s.data.tobytes()
        starts, ends, alone = _parts(s)
        others = np.concatenate([[0], np.cumsum(~_PLAIN[s.data])])

        def tokenised(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = starts[which], ends[which]
            return self._tokenised([data[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], others[b] == others[a])

        hashes, place, number = np.unique(s.span_hashes(starts[~alone], ends[~alone], lower=True), return_index=True, return_inverse=True)
        at, known = self._find(hashes)
        if not known.all():
            if len(self.hashes) + len(hashes) > self.remembered or len(self.ids) > 8 * self.remembered:
                self._forget()
                known[:] = False
            counts, ids = tokenised(np.flatnonzero(~alone)[place[~known]])
            at = np.searchsorted(self.hashes, hashes[~known])
            self.hashes = np.insert(self.hashes, at, hashes[~known])
            self.first = np.insert(self.first, at, len(self.ids) + np.cumsum(counts) - counts)
            self.count = np.insert(self.count, at, counts)
            self.ids = np.concatenate([self.ids, ids])
            at, _ = self._find(hashes)
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first[~alone], count[~alone] = self.first[at][number], self.count[at][number]
        count[alone], more = tokenised(np.flatnonzero(alone))
        first[alone] = len(self.ids) + np.cumsum(count[alone]) - count[alone]
        upto = np.concatenate([[0], np.cumsum(count)])
        bounds = upto[np.searchsorted(starts, s.offsets)]
        found = np.concatenate([self.ids, more])[np.arange(upto[-1]) + np.repeat(first - upto[:-1], count)]
        return np.insert(found, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))


_loaded: dict[str, WordIds] = {}


def _cut(path: str, capacity: int, end_id: int, keep_ids: bool, n_keep: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = WordIds(path)
        words = _loaded[path]
        for batch in batches:
            for s in slices(batch.column(n_keep)):
                ids, bounds = words.of(s, end_id)
                sizes = np.diff(bounds)
                many = -(-sizes // capacity)
                row = np.repeat(np.arange(len(s)), many)
                number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = number * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = bounds[row] + start
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                take = pa.array(row + s.first)
                columns = [batch.column(c).take(take) for c in range(n_keep)]
                columns += [pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                names = [f"_k{c}" for c in range(n_keep)] + ["piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pieces


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per piece of at most capacity tokens: keep, piece, start, length, ids_crc32 and the ids themselves.

    Only texts with more tokens are cut, and the last piece may be shorter. The end id follows every text, so an
    empty or null one has a single piece of one token.
    """
    schema = [f"_k{i} {dict(docs.dtypes)[c]}" for i, c in enumerate(keep)] + ["piece int", "start long", "length long", "ids_crc32 long"] + ["ids array<int>"] * keep_ids
    cut = docs.select(*keep, "text").mapInArrow(_cut(path, capacity, end_id, keep_ids, len(keep)), ", ".join(schema))
    return cut.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})


Bins = list[list[int]]


def best_fit(items: list[int], lengths: list[int], bins: Bins, room: list[int], capacity: int) -> None:
    """Put items, longest first, each into the fullest bin that still holds it; bins and the room left in each are changed."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in sorted(items, key=lambda i: (-lengths[i], i)):
        at = bisect_left(free, (lengths[i], -1))
        if at == len(free):
            bins.append([i])
            room.append(capacity - lengths[i])
            if room[-1]:
                insort(free, (room[-1], len(bins) - 1))
            continue
        left, b = free.pop(at)
        bins[b].append(i)
        room[b] = left - lengths[i]
        if room[b]:
            insort(free, (room[b], b))


def fitness(bins: Bins, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Smaller is better: the number of bins, then how evenly they are filled (full bins beside empty ones are best)."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(one: Bins, other: Bins, lengths: list[int], capacity: int, rng: Random) -> Bins:
    """A child of one, with whole well-filled bins of other.

    Bins of one that hold an injected document go, and their other documents, with those of a few of the worst
    filled bins, are put back by best fit.
    """
    fills = sorted(range(len(other)), key=lambda b: -sum(lengths[i] for i in other[b]))
    best = fills[: max(1, len(fills) // 2)]
    injected = [other[b] for b in rng.sample(best, max(1, len(best) // 4))]
    taken = {i for b in injected for i in b}
    bins, displaced = [list(b) for b in injected], []
    rest = []
    for b in one:
        if taken.isdisjoint(b):
            rest.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    rest.sort(key=lambda b: sum(lengths[i] for i in b))
    opened = rng.randint(0, max(1, len(rest) // 50))
    displaced += [i for b in rest[:opened] for i in b]
    bins += [list(b) for b in rest[opened:]]
    best_fit(displaced, lengths, bins, [capacity - sum(lengths[i] for i in b) for b in bins], capacity)
    return bins


def evolve(lengths: list[int], elites: list[Bins], capacity: int, rng: Random, population: int = POPULATION, generations: int = GENERATIONS) -> Bins:
    """The best solution after some generations that start from the elites, filled up with best fit over shuffled lengths."""
    everything = list(range(len(lengths)))
    bound = -(-sum(lengths) // capacity)
    pool = list(elites)
    while len(pool) < population:
        bins: Bins = []
        room: list[int] = []
        if not pool:
            best_fit(everything, lengths, bins, room, capacity)
        else:
            early = rng.sample(everything, len(everything) // 3)
            best_fit(early, lengths, bins, room, capacity)
            placed = set(early)
            best_fit([i for i in everything if i not in placed], lengths, bins, room, capacity)
        pool.append(bins)
    scored = sorted(((fitness(b, lengths, capacity), n, b) for n, b in enumerate(pool)), key=lambda x: x[:2])
    for turn in range(generations):
        if scored[0][0][0] <= bound:
            break
        a, b = rng.sample(range(len(scored)), 2) if len(scored) > 1 else (0, 0)
        child = crossover(scored[min(a, b)][2], scored[max(a, b)][2], lengths, capacity, rng)
        scored.append((fitness(child, lengths, capacity), population + turn, child))
        scored = sorted(scored, key=lambda x: x[:2])[:population]
    return scored[0][2]


def _island(epoch: int, seed: int, capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """One island of one shard: its pieces, and in later epochs the bins of its own elite and of the neighbour's."""
        shard, island = int(group["shard"].iloc[0]), int(group["island"].iloc[0])
        own = group[group["elite"] == group["elite"].min()].sort_values(["length", "pid"], ascending=[False, True])
        pids, lengths = own["pid"].tolist(), own["length"].tolist()
        place = {p: i for i, p in enumerate(pids)}
        elites = []
        if epoch:
            for _, solution in group.groupby("elite"):
                bins: dict[int, list[int]] = {}
                for p, b in zip(solution["pid"], solution["bin"], strict=True):
                    bins.setdefault(b, []).append(place[p])
                elites.append([bins[b] for b in sorted(bins)])
        best = evolve(lengths, elites, capacity, Random(f"{seed}/{epoch}/{shard}/{island}"))
        score = fitness(best, lengths, capacity)
        at = [i for b in best for i in b]
        sizes = [len(b) for b in best]
        fills = [sum(lengths[i] for i in b) for b in best]
        return pd.DataFrame({
            "shard": shard, "island": island, "pid": [pids[i] for i in at], "length": [lengths[i] for i in at],
            "bin": np.repeat(np.arange(len(best)), sizes), "fill": np.repeat(fills, sizes), "n_bins": score[0], "score": score[1],
        })

    return run


_SOLUTION = "shard long, island int, pid long, length long, bin long, fill long, n_bins long, score double"


def _solve(pieces: DataFrame, seed: int, capacity: int, islands: int, epochs: int) -> tuple[DataFrame, int]:
    """The best island's bins for each shard of (pid, length), written, and the number of shards."""
    shards = max(1, -(-pieces.count() // SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(shards)))
    state = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumns({"elite": F.lit(0), "bin": F.lit(0).cast("long")})
    for epoch in range(epochs):
        solved = freeze(state.groupBy("shard", "island").applyInPandas(_island(epoch, seed, capacity), _SOLUTION), "islands")
        move = F.explode(F.array(F.struct(F.col("island").alias("to"), F.lit(0).alias("elite")), F.struct(((F.col("island") + 1) % islands).alias("to"), F.lit(1).alias("elite"))))
        state = solved.withColumn("_m", move).select("shard", F.col("_m.to").alias("island"), F.col("_m.elite").alias("elite"), "pid", "length", "bin")
    best = solved.groupBy("shard").agg(F.min(F.struct("n_bins", "score", "island")).alias("_b")).select("shard", F.col("_b.island").alias("island"))
    return solved.join(best, ["shard", "island"]), shards


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 11, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with a column length (1 to capacity).

    Full pieces are sequences of their own. The others are dealt at random into shards of about SHARD_PIECES; the
    islands of a shard evolve packings of it apart, and between epochs each island's best moves to the next one.
    Badly filled bins of all shards are opened and packed again together, so the waste does not grow with the
    number of shards. Nothing but piece numbers and lengths is shuffled or solved, and no group exceeds about
    SHARD_PIECES pieces on each island. The pieces are numbered once they are written; repeated rows are pieces of
    their own. Offsets are gapless from 0 in each sequence.
    """
    numbered = freeze(pieces.withColumn("_pid", F.monotonically_increasing_id()), "pieces")
    todo = numbered.where(F.col("length") < capacity).select(F.col("_pid").alias("pid"), "length")
    placed = None
    for turn in range(REPACKS + 1):
        solved, shards = _solve(todo, seed + turn, capacity, islands, epochs)
        again = (F.col("fill") < WELL_FILLED * capacity) if shards > 1 and turn < REPACKS else F.lit(False)
        done = solved.where(~again).select("pid", (F.lit(turn) * (1 << 58) + F.col("shard") * (1 << 26) + F.col("bin")).alias("sequence_id"))
        placed = done if placed is None else placed.unionByName(done)
        if shards == 1 or turn == REPACKS:
            break
        todo = freeze(solved.where(again).select("pid", "length"), "again")
    both = numbered.join(placed, numbered["_pid"] == placed["pid"], "left").withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("_pid")))
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "_pid").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("offset", F.sum("length").over(before) - F.col("length")).drop("_pid", "pid")


def pack_documents(docs: DataFrame, path: str, keep_ids: bool = True, **options) -> DataFrame:
    """Tokenise docs and pack the pieces: doc_id, piece, start, length, ids_crc32, ids if kept, sequence_id, offset."""
    return pack(tokenize(docs, path, keep_ids=keep_ids), **options)
