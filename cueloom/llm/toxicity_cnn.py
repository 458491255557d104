"""Toxicity: a convolutional text classifier over hashed word embeddings, trained shard by shard in numpy, with thresholds by language."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze, release
from cueloom.llm.idfilter import Filter
from cueloom.llm.textscan import Slice, slices

#: Labelled documents and words of a shard, about. Each shard is learned from by a copy of the network; the copies are averaged after each round.
SHARD_ROWS, SHARD_WORDS = 16_384, 8_000_000
#: Rounds in which several shards go through their epochs; one alone has nothing to be averaged with.
ROUNDS = 3
#: Labels up to which they (about 16 bytes each) are broadcast; beyond, a filter of their ids parts the texts in the scan and those are shuffled.
BROADCAST_LABELS = 200_000
#: Languages with a threshold of their own up to which they are broadcast.
BROADCAST_LANGS = 50_000
#: Each fifth labelled document by hash fits no filter: the probability scale and the thresholds are set on it.
CALIBRATION_FOLDS = 5
#: Every third document by checksum is held out.
FOLDS, HELD_OUT = 3, 1
#: A word is two rows of tables of 2**BUCKET_BITS rows and a third for its first PREFIX_BYTES, so chance meetings in one of them weigh little.
BUCKET_BITS, TABLES, PREFIX_BYTES = 15, 3, 4
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Texts are gone through at least EPOCHS times and until about STEPS batches of each shard have been seen, so that few texts teach as well.
EPOCHS, STEPS, BATCH = 6, 200, 32
RATE = 0.1
#: Words that fewer of the documents learned from have are known by their first bytes only while learning: else they would tell documents apart, not toxicity.
#: It is 3, as the lowest and the highest document of a word name all that a rare one has.
LEAST_DOCUMENTS = 3
#: The first dimension of an embedding starts at the log odds of its bucket by label, with so many documents added to each count, times a factor.
ADDED, ODDS = 2.0, 0.3
#: Words whose filter outputs are held at once, which bounds memory whatever a text's length.
BLOCK_WORDS = 1 << 16
#: A language with fewer toxic documents to calibrate on than this has the threshold of all languages together.
LEAST_TOXIC = 20
#: What score counts as toxic where no threshold could be set.
CUT = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _words(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, where each row's begin): words are runs of letters and digits, general punctuation and marks cut them; A-Z count as a-z."""
    d, n = s.data, len(s.data)
    letter = _LETTER[d]
    marks = np.flatnonzero((d[:-2] == 0xE2) & (d[1:-1] == 0x80)) if n > 2 else np.zeros(0, np.int64)
    for k in range(3):
        letter[marks + k] = False
    edge = np.zeros(n + 1, bool)
    edge[s.offsets] = True
    starts = np.flatnonzero(letter & (edge[:-1] | ~np.concatenate([[False], letter[:-1]])))
    ends = np.flatnonzero(letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
    whole = s.span_hashes(starts, ends, lower=True)
    front = s.span_hashes(starts, np.minimum(starts + PREFIX_BYTES, ends), lower=True)
    mask = np.uint64((1 << BUCKET_BITS) - 1)
    buckets = np.stack([whole & mask, (whole >> np.uint64(BUCKET_BITS)) & mask, front & mask], axis=1).astype(np.uint16)
    return buckets, np.searchsorted(starts, s.offsets)


@dataclass
class Network:
    """Embeddings, filters of each width at each offset, and the weights of the pooled outputs."""

    tables: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, size: (rng.standard_normal(shape) * size).astype(np.float32)
        return cls(f32(TABLES, 1 << BUCKET_BITS, DIMENSIONS, size=0.05), f32(DIMENSIONS, sum(WIDTHS) * FILTERS, size=0.25), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.abs(f32(len(WIDTHS) * FILTERS, size=0.3)))

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        x = self.tables[0][buckets[:, 0]]
        for k in range(1, TABLES):
            x += self.tables[k][buckets[:, k]]
        return x

    def outputs(self, buckets: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Filter outputs of each word; left counts the words from it to its text's end. A filter that reaches beyond the end sees zeros there."""
        y = self.embed(buckets) @ self.filters
        z = np.empty((len(y), len(WIDTHS) * FILTERS), np.float32)
        slot = 0
        for k, width in enumerate(WIDTHS):
            z[:, k * FILTERS : (k + 1) * FILTERS] = own = y[:, slot * FILTERS : (slot + 1) * FILTERS] + self.bias[k * FILTERS : (k + 1) * FILTERS]
            for j in range(1, width):
                part = y[j:, (slot + j) * FILTERS : (slot + j + 1) * FILTERS]
                own[: len(part)] += part * (left[: len(part), None] > j)
            z[:, k * FILTERS : (k + 1) * FILTERS] = own
            slot += width
        return z

    def tops(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(highest output, word of its text at which it is first) of each text with words and each filter."""
        sizes, reach = [len(t) for t in texts], max(WIDTHS) - 1
        best, top = np.empty((len(texts), len(self.bias)), np.float32), np.empty((len(texts), len(self.bias)), np.int64)
        columns, first = np.arange(len(self.bias)), 0
        while first < len(texts):
            last = first + 1
            while last < len(texts) and sum(sizes[first : last + 1]) <= BLOCK_WORDS:
                last += 1
            bounds = np.concatenate([[0], np.cumsum(sizes[first:last])])
            buckets = texts[first] if last == first + 1 else np.concatenate(texts[first:last])
            left = np.repeat(bounds[1:], sizes[first:last]) - np.arange(len(buckets))
            best[first:last] = -np.inf
            for a in range(0, len(buckets), BLOCK_WORDS):  # more than one block is one text's
                b = min(a + BLOCK_WORDS, len(buckets))
                z = self.outputs(buckets[a : b + reach], left[a : b + reach])[: b - a]
                for r in range(first, last):
                    start = max(bounds[r - first] - a, 0)
                    own = z[start : max(bounds[r - first + 1] - a, 0)]
                    at = own.argmax(axis=0)
                    value = own[at, columns]
                    higher = value > best[r]
                    best[r] = np.where(higher, value, best[r])
                    top[r] = np.where(higher, at + start + a - bounds[r - first], top[r])
            first = last
        return best, top

    def logits(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts whose words stand at bounds: each filter's highest output, none below 0, weighted and summed. A text without words has the bias alone."""
        n, reach = len(bounds) - 1, max(WIDTHS) - 1
        pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        filled = np.flatnonzero(np.diff(bounds))
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(buckets))
        for a in range(0, len(buckets), BLOCK_WORDS):
            b = min(a + BLOCK_WORDS, len(buckets))
            z = self.outputs(buckets[a : b + reach], left[a : b + reach])
            rows = filled[(bounds[filled] < b) & (bounds[filled + 1] > a)]
            pooled[rows] = np.maximum(pooled[rows], np.maximum.reduceat(z[: b - a], np.maximum(bounds[rows] - a, 0)))
        return pooled @ self.out + self.out_bias

    def scores(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(buckets, bounds).astype(float) + self.shift, -30, 30)))


#: All weights as rows of DIMENSIONS numbers: the embeddings, the filters, then the rest, with zeros at the end.
_EMBEDDINGS, _UNITS = TABLES << BUCKET_BITS, len(WIDTHS) * FILTERS
_REST = _EMBEDDINGS + sum(WIDTHS) * FILTERS
PACKED_ROWS = _REST - (-(2 * _UNITS + 1) // DIMENSIONS)


def packed(tables: np.ndarray, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: float) -> np.ndarray:
    rows = np.zeros((PACKED_ROWS, DIMENSIONS), np.float32)
    rows[:_EMBEDDINGS], rows[_EMBEDDINGS:_REST] = tables.reshape(-1, DIMENSIONS), filters.reshape(-1, DIMENSIONS)
    rows[_REST:].reshape(-1)[: 2 * _UNITS + 1] = np.concatenate([bias, out, [out_bias]])
    return rows


def unpacked(rows: np.ndarray) -> Network:
    """A network with its own copy of packed weights."""
    rest = rows[_REST:].reshape(-1)
    return Network(rows[:_EMBEDDINGS].reshape(TABLES, -1, DIMENSIONS).copy(), rows[_EMBEDDINGS:_REST].reshape(DIMENSIONS, -1).copy(), rest[:_UNITS].copy(), rest[_UNITS : 2 * _UNITS].copy(), float(rest[2 * _UNITS]))


class Trainer:
    """Gradient steps on a network: only the words at which filters are highest learn from a text."""

    def __init__(self, network: Network, seen: np.ndarray | None = None) -> None:
        self.net = network
        past = unpacked(np.full((PACKED_ROWS, DIMENSIONS), 1e-3, np.float32) if seen is None else seen)
        self.seen = {name: getattr(past, name) for name in ("tables", "filters", "bias", "out")}
        self.seen_bias = past.out_bias

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        net, n = self.net, len(texts)
        sizes = np.array([len(t) for t in texts])
        best, top = net.tops(texts)
        pooled = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -30, 30)))
        error = ((p - y) * weight / n).astype(np.float32)
        back = error[:, None] * net.out[None, :] * (pooled > 0)
        own, learned = [], []
        grad = np.zeros_like(net.filters)
        slot = 0
        for k, width in enumerate(WIDTHS):
            at, g = top[:, k * FILTERS : (k + 1) * FILTERS], back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                cols = slice((slot + j) * FILTERS, (slot + j + 1) * FILTERS)
                inside = at + j < sizes[:, None]
                row, h = np.where(inside, at + j, 0), g * inside
                met = np.concatenate([t[w] for t, w in zip(texts, row, strict=True)])
                grad[:, cols] = np.einsum("nf,nfd->df", h, net.embed(met).reshape(n, FILTERS, DIMENSIONS))
                own.append(met)
                learned.append((h[:, :, None] * net.filters[:, cols].T[None]).reshape(-1, DIMENSIONS))
            slot += width
        own, learned = np.concatenate(own), np.concatenate(learned)
        for k in range(TABLES):
            ids, inverse = np.unique(own[:, k], return_inverse=True)
            sums = np.zeros((len(ids), DIMENSIONS), np.float32)
            np.add.at(sums, inverse, learned)
            self.seen["tables"][k][ids] += sums * sums
            net.tables[k][ids] -= RATE * sums / np.sqrt(self.seen["tables"][k][ids])
        for name, g in (("filters", grad), ("bias", back.sum(axis=0)), ("out", pooled.T @ error)):
            self.seen[name] += g * g
            getattr(net, name)[...] -= RATE * g / np.sqrt(self.seen[name])
        self.seen_bias += float(error.sum()) ** 2
        net.out_bias -= RATE * float(error.sum()) / self.seen_bias**0.5


def _codes(buckets: np.ndarray) -> np.ndarray:
    """One number for each word, of its buckets."""
    return sum(buckets[:, k].astype(np.int64) << (BUCKET_BITS * k) for k in range(TABLES))


def _lists(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all words, where each row's begin) of a column of lists."""
    return words.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _buckets(codes: np.ndarray) -> np.ndarray:
    return np.stack([((codes >> (BUCKET_BITS * k)) & ((1 << BUCKET_BITS) - 1)).astype(np.uint16) for k in range(TABLES)], axis=1)


def _first_and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (doc_id, words): each word of a batch, how many rows have it, and the doc_id of the first and the last."""
    for batch in batches:
        codes, bounds = _lists(batch.column(1))
        each = [np.unique(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        row = np.repeat(np.arange(len(each)), [len(e) for e in each])
        every = np.concatenate([np.zeros(0, np.int64), *each])
        order = np.argsort(every, kind="stable")
        every, row = every[order], row[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]]))
        ends = np.append(starts[1:], len(every))[: len(starts)]
        yield pa.RecordBatch.from_arrays([pa.array(every[starts]), pa.array((ends - starts).astype(np.int64)), batch.column(0).take(pa.array(row[starts])), batch.column(0).take(pa.array(row[ends - 1]))], names=["word", "n", "low", "high"])


def rare_words(fitted: DataFrame) -> DataFrame:
    """(_id, _rare: words of it that fewer than LEAST_DOCUMENTS documents have) of rows (doc_id, words), doc_id once each."""
    kind = fitted.schema["doc_id"].dataType.simpleString()
    counts = fitted.select("doc_id", "words").mapInArrow(_first_and_last, f"word long, n long, low {kind}, high {kind}")
    rare = counts.groupBy("word").agg(F.sum("n").alias("n"), F.min(F.least("low", "high")).alias("low"), F.max(F.greatest("low", "high")).alias("high")).where(F.col("n") < LEAST_DOCUMENTS)
    return rare.select("word", F.explode(F.array_distinct(F.array("low", "high"))).alias("_id")).groupBy("_id").agg(F.collect_list("word").alias("_rare"))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, toxic, words, rare words): the rare ones share one bucket, beside those of their first bytes."""
    prefix = ((1 << BUCKET_BITS) - 1) << (BUCKET_BITS * (TABLES - 1))
    for batch in batches:
        (codes, bounds), (rare, at) = _lists(batch.column(2)), _lists(batch.column(3))
        codes = codes.copy()
        for r in np.flatnonzero(np.diff(at)):
            own = codes[bounds[r] : bounds[r + 1]]
            own[np.isin(own, rare[at[r] : at[r + 1]])] &= prefix
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codes))], names=["shard", "toxic", "words"])


def in_shards(fitted: DataFrame, n: int) -> DataFrame:
    """(shard, toxic, words) of documents to fit filters to, a shard in one file and in an order that doc_id decides."""
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(n)).cast("int")
    rows = fitted.join(rare_words(fitted), F.col("doc_id") == F.col("_id"), "left").select("doc_id", shard.alias("shard"), "toxic", "words", F.coalesce("_rare", F.array().cast("array<long>")).alias("_rare"))
    dealt = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("doc_id"), "doc_id")
    return freeze(dealt.select("shard", "toxic", "words", "_rare").mapInArrow(_spread, "shard int, toxic int, words array<long>"), "shards")


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows (shard, toxic, words) of either label have a word of each bucket."""
    counts = np.zeros((2, TABLES << BUCKET_BITS), np.int64)
    for batch in batches:
        codes, bounds = _lists(batch.column(2))
        buckets = _buckets(codes).astype(np.int64) + (np.arange(TABLES) << BUCKET_BITS)
        for y, a, b in zip(batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
            counts[y, np.unique(buckets[a:b])] += 1
    y, at = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[y, at])], names=["toxic", "bucket", "n"])


def log_odds(shards: DataFrame, whole: tuple[int, int]) -> np.ndarray:
    """How much likelier toxic documents are to have a word of each bucket of each table than others are, of which there are whole; 0 where none has one."""
    found = shards.mapInArrow(_tallied, "toxic int, bucket int, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, TABLES << BUCKET_BITS))
    counts[found.column("toxic").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    odds = np.log((counts[1] + ADDED) / (whole[1] + ADDED)) - np.log((counts[0] + ADDED) / (whole[0] + ADDED))
    return np.where(counts.sum(axis=0) > 0, odds, 0).reshape(TABLES, -1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(number, buckets of each text with words, labels) of each shard, whose rows follow one another."""
    now, texts, toxic = None, [], []
    for batch in batches:
        codes, bounds = _lists(batch.column(2))
        buckets = _buckets(codes)
        for shard, y, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds[:-1], bounds[1:], strict=True):
            if shard != now:
                if texts:
                    yield now, texts, np.array(toxic)
                now, texts, toxic = shard, [], []
            if b > a:
                texts.append(buckets[a:b])
                toxic.append(y)
    if texts:
        yield now, texts, np.array(toxic)


#: Rows of packed weights that are averaged together.
GROUP = 4096


def _learned(model, weights: tuple[float, float], passes: int, seed: tuple[int, ...]):
    """What all shards of a task move each row of weights by, and its squared slopes; of each row how many shards moved it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, past = model.value
        moved, slopes, shards = np.zeros(start.shape), np.zeros(start.shape), np.zeros(len(start), np.int32)
        for shard, texts, toxic in _shards(batches):
            net, rng = unpacked(start), np.random.default_rng([*seed, shard])
            trainer, weight = Trainer(net, past), np.array(weights)[toxic]
            for _ in range(passes):
                order = rng.permutation(len(texts))
                for i in range(0, len(order), BATCH):
                    some = order[i : i + BATCH]
                    trainer.step([texts[k] for k in some], toxic[some], weight[some])
            seen = packed(*trainer.seen.values(), trainer.seen_bias) - past
            moved += packed(net.tables, net.filters, net.bias, net.out, net.out_bias) - start
            slopes += seen
            shards += seen.any(axis=1)
        rows = np.flatnonzero(shards)
        cuts = np.searchsorted(rows, np.arange(0, len(start) + GROUP, GROUP))
        parts = [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        raw = lambda kind, values: pa.array([values[p].astype(kind).tobytes() for p in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([int(p[0]) // GROUP for p in parts], pa.int32()), raw(np.int32, np.arange(len(start))), raw(np.float32, moved), raw(np.float32, slopes), raw(np.int32, shards)], names=["part", "rows", "moved", "slopes", "shards"])

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """One part's rows with what moved them, averaged over the shards that did."""
    moved, slopes, shards = np.zeros((GROUP, DIMENSIONS)), np.zeros((GROUP, DIMENSIONS)), np.zeros(GROUP, np.int64)
    part = table.column("part")[0].as_py()
    for r in table.to_pylist():
        at = np.frombuffer(r["rows"], np.int32) - part * GROUP
        moved[at] += np.frombuffer(r["moved"], np.float32).reshape(-1, DIMENSIONS)
        slopes[at] += np.frombuffer(r["slopes"], np.float32).reshape(-1, DIMENSIONS)
        shards[at] += np.frombuffer(r["shards"], np.int32)
    at = np.flatnonzero(shards)
    mean = lambda sums: pa.array([(sums[at] / shards[at, None]).astype(np.float32).tobytes()], pa.binary())
    return pa.table({"rows": pa.array([(at + part * GROUP).astype(np.int32).tobytes()], pa.binary()), "moved": mean(moved), "slopes": mean(slopes)})


def train(net: Network, shards: DataFrame, n_shards: int, usable: tuple[int, int], seed: int = 1) -> Network:
    """The network fitted to all rows of shards, usable of either label with words; both kinds weigh the same in all.

    In each round every shard trains a copy of the network; each weight then moves by the mean over the shards that moved it.
    """
    share = usable[1] / sum(usable)
    rounds = 1 if n_shards == 1 else ROUNDS
    passes = -(-max(EPOCHS, -(-STEPS * BATCH * n_shards // sum(usable))) // rounds)
    rows, seen = packed(net.tables, net.filters, net.bias, net.out, net.out_bias), np.full((PACKED_ROWS, DIMENSIONS), 1e-3, np.float32)
    for k in range(rounds):
        model = shards.sparkSession.sparkContext.broadcast((rows, seen))
        sums = shards.mapInArrow(_learned(model, (0.5 / (1 - share), 0.5 / share), passes, (seed, k)), "part int, rows binary, moved binary, slopes binary, shards binary")
        means = sums.groupBy("part").applyInArrow(_averaged, "rows binary, moved binary, slopes binary").toArrow().to_pylist()
        model.destroy()
        for r in means:
            at = np.frombuffer(r["rows"], np.int32)
            rows[at] += np.frombuffer(r["moved"], np.float32).reshape(-1, DIMENSIONS)
            seen[at] += np.frombuffer(r["slopes"], np.float32).reshape(-1, DIMENSIONS)
    return unpacked(rows)


def _newton(sums: Callable[[float, float], tuple[float, ...]]) -> tuple[float, float]:
    """Scale and shift by Newton's method from sums over all rows: the loss, its slopes by scale and shift, its curvatures by scale, both and shift.

    A step under which the loss would grow, as when labels are separable and curvatures vanish, is halved.
    """

    def at(a: float, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        loss, ga, gb, haa, hab, hbb = sums(a, b)
        return loss + 5e-4 * (a - 1) ** 2 + 5e-7 * b * b, np.array([ga + 1e-3 * (a - 1), gb + 1e-6 * b]), np.array([[haa + 1e-3, hab], [hab, hbb + 1e-6]])

    a, b = 1.0, 0.0
    loss, g, h = at(a, b)
    for _ in range(50):
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        new = at(a - step[0], b - step[1])
        while new[0] > loss + 1e-12 * (1 + loss) and np.abs(step).max() >= 1e-7:
            step /= 2
            new = at(a - step[0], b - step[1])
        a, b, (loss, g, h) = a - step[0], b - step[1], new
        if np.abs(step).max() < 1e-7:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def calibrate(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift under which logistic scores fit labels best, by Newton's method; labels are drawn in a little, so that separable ones give finite values."""
    near = np.where(toxic == 1, (toxic.sum() + 1) / (toxic.sum() + 2), 1 / ((1 - toxic).sum() + 2))

    def sums(a: float, b: float) -> tuple[float, ...]:
        z = a * logits + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, w = weight * (p - near), weight * p * (1 - p)
        return (weight * (np.logaddexp(0, z) - near * z)).sum(), (g * logits).sum(), g.sum(), (w * logits * logits).sum(), (w * logits).sum(), w.sum()

    return _newton(sums)


def _logistic(scale: float, shift: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(F.col("logit") * scale + shift, F.lit(30.0)), F.lit(-30.0))))


def calibrate_rows(held: DataFrame, clean: int, toxic: int) -> tuple[float, float]:
    """As calibrate(), of rows (toxic, logit), of which there are so many, by one aggregation a step. Sums are decimal, so no order of rows changes them."""
    near = F.when(F.col("toxic") == 1, (toxic + 1) / (toxic + 2)).otherwise(1 / (clean + 2))

    def sums(a: float, b: float) -> tuple[float, ...]:
        rows = held.select("logit", _logistic(a, b).alias("p"), near.alias("near"), (F.col("logit") * a + b).alias("z"))
        loss = F.log1p(F.exp(-F.abs("z"))) + F.greatest("z", F.lit(0.0)) - F.col("near") * F.col("z")
        g, w, x = F.col("p") - F.col("near"), F.col("p") * (1 - F.col("p")), F.col("logit")
        return tuple(float(v) for v in rows.agg(*[F.sum(t.cast("decimal(28,15)")).alias(f"s{i}") for i, t in enumerate((loss, g * x, g, w * x * x, w * x, w))]).first())

    return _newton(sums)


def best_threshold(scores: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which flagged documents have the highest F1, weighted as the corpus is; CUT without toxic ones."""
    if not toxic.sum():
        return CUT
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum((weight * toxic)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + hit[-1])
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] / 2)


def best_thresholds(held: DataFrame) -> DataFrame:
    """(whole, lang, n_toxic, threshold) of rows (lang, toxic, score): best_threshold() of each language, and with whole of all together.

    Equal scores are counted first. Counts above a score are those of the ranges above its own and of the scores above it
    in its range, so that no task sees a whole language.
    """
    both = held.select(F.lit(False).alias("whole"), "lang", "toxic", "score").unionByName(held.select(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("lang"), "toxic", "score"))
    points = both.groupBy("whole", "lang", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    points = freeze(points.repartitionByRange("whole", "lang", F.desc("score")).withColumn("range", F.spark_partition_id()), "points")
    group, key = ("whole", "lang"), F.struct("whole", "lang", "range")
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = points.groupBy(*group, "range").agg(F.sum("n").alias("_n"), F.sum("hits").alias("_hits"))
    bases = bases.select(key.alias("_key"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", "_hits")], F.sum("_hits").over(Window.partitionBy(*group)).alias("n_toxic"))
    down = Window.partitionBy(*group, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    summed = points.select(*group, "range", "score", F.sum("n").over(down).alias("n"), F.sum("hits").over(down).alias("hits")).join(bases, key.eqNullSafe(F.col("_key")))
    f1 = 2 * (F.col("hits") + F.col("_hits")) / (F.col("n") + F.col("_n") + F.col("n_toxic"))
    best = summed.groupBy(*group).agg(F.max(F.struct(f1.alias("f1"), "score"))["score"].alias("best"), F.max("n_toxic").alias("n_toxic"))
    best = freeze(best.select(F.struct(*group).alias("_group"), "best", "n_toxic"), "best", few=True)
    below = points.join(best, F.struct(*group).eqNullSafe(F.col("_group"))).groupBy("_group").agg(F.max("best").alias("best"), F.max("n_toxic").alias("n_toxic"), F.max(F.when(F.col("score") < F.col("best"), F.col("score"))).alias("next"))
    threshold = F.when(F.col("n_toxic") > 0, (F.col("best") + F.coalesce("next", F.lit(0.0))) / 2).otherwise(CUT)
    found = freeze(below.select("_group.whole", "_group.lang", "n_toxic", threshold.alias("threshold")), "thresholds", few=True)
    release(points, best)
    return found


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != HELD_OUT


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the texts in the last column by their words' buckets, one number a word."""
    for batch in batches:
        last = batch.num_columns - 1
        for s in slices(batch.column(last)):
            buckets, bounds = _words(s)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(s.first, len(s)) for c in range(last)], pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_codes(buckets)))], names=[*batch.schema.names[:-1], "words"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, lang, fold, words, n words) of every labelled training document.

    Null labels and ids are ignored; a document with several labels has the highest, one with several rows the first by text.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & in_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = freeze(known.withColumnRenamed("doc_id", "_id"), "labels", few=True)
    n, kind = known.count(), docs.schema["doc_id"].dataType
    texts = docs.where(in_training(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    if n <= BROADCAST_LABELS:
        own = F.broadcast(known)
    else:
        texts = Filter(known.select(F.col("_id").try_cast(kind).alias("_id")), n).mark(texts, "doc_id", "_hit").where("_hit").drop("_hit")
        own = known.hint("merge")
    found = texts.join(own, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(CALIBRATION_FOLDS)).cast("int")
    words = found.select("doc_id", "toxic", "x.lang", fold.alias("fold"), "x.text").mapInArrow(_bucketed, f"doc_id {kind.simpleString()}, toxic int, lang string, fold int, words array<long>")
    return freeze(words.withColumn("n", F.size("words")), "words")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Network, float, DataFrame | None]:
    """(network with its scale, threshold of all languages, rows (lang, threshold) or None) from all labels of training documents.

    Filters are fitted to four fifths of the documents, the rest sets the probability scale and the thresholds. The driver
    holds the network and counts by bucket and label, whatever the input. Without both labels scores are those of an
    untrained network scaled below CUT.
    """
    words = labelled(docs, labels)
    held_out = (F.col("fold") == 0).alias("held")
    counts = {(r["held"], r["toxic"]): r for r in words.groupBy(held_out, "toxic").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("n") > 0).cast("long")).alias("usable"), F.sum("n").alias("words")).collect()}
    of = lambda held, column: tuple(counts[held, y][column] if (held, y) in counts else 0 for y in (0, 1))
    net = Network.fresh()
    if all(of(False, "rows")):
        n = max(-(-sum(of(False, "rows")) // SHARD_ROWS), -(-sum(of(False, "words")) // SHARD_WORDS))
        shards = in_shards(words.where("fold != 0"), n)
        net.tables[:, :, 0] += ODDS * log_odds(shards, of(False, "rows"))
        if all(of(False, "usable")):
            net = train(net, shards, n, of(False, "usable"))
        release(shards)
    clean, toxic = of(True, "rows")
    net.scale, net.shift = 1.0, 0.0 if all(a + b for a, b in zip(of(True, "rows"), of(False, "rows"), strict=True)) else -2.0
    if not (clean and toxic):
        release(words)
        return net, CUT, None
    model = docs.sparkSession.sparkContext.broadcast(net)
    held = freeze(words.where("fold = 0").select("lang", "toxic", "words").mapInArrow(_logits(model), "lang string, toxic int, logit double"), "held", few=True)
    model.destroy()
    net.scale, net.shift = calibrate_rows(held, clean, toxic)
    found = best_thresholds(held.select("lang", "toxic", _logistic(net.scale, net.shift).alias("score")))
    release(words, held)
    return net, found.where("whole").first()["threshold"], found.where(~F.col("whole") & (F.col("n_toxic") >= LEAST_TOXIC)).select("lang", "threshold")


def _logits(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            codes, bounds = _lists(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(net.logits(_buckets(codes), bounds).astype(float))], names=["lang", "toxic", "logit"])

    return run


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            last = batch.num_columns - 1
            for s in slices(batch.column(last), 1 << 20):
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(s.first, len(s)) for c in range(last)], pa.array(net.scores(*_words(s)))], names=[*batch.schema.names[:-1], "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged) of every row's whole text.

    score comes from the text alone; predicted says whether it reaches CUT. flagged says whether it reaches the threshold
    that was calibrated for the row's language, or that of all languages where too few toxic documents could be learned from. A null
    text is empty, and empty texts have the score of the network's bias. Repeated rows are scored alike; a null doc_id is not held out, an empty
    table gives an empty one. To score, no text is shuffled: the network (about 6 MB) is broadcast, and so are the thresholds unless there are more than BROADCAST_LANGS.
    """
    spark = docs.sparkSession
    net, overall, by_lang = fit(docs.withColumn("lang", F.col(lang)), labels)
    rows = docs.select("doc_id", F.col(lang).cast("string").alias("lang"), "text")
    scored = rows.mapInArrow(_scored(spark.sparkContext.broadcast(net)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, score double")
    thresholds = spark.createDataFrame([], "_lang string, _threshold double") if by_lang is None else by_lang.toDF("_lang", "_threshold")
    few = by_lang is None or by_lang.count() <= BROADCAST_LANGS
    joined = scored.join(F.broadcast(thresholds) if few else thresholds, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("_threshold", F.lit(overall)))
    held_out = ~in_training(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return joined.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
