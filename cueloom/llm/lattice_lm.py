"""Language-model scoring by subword lattices: all segmentations of each word count, weighted by unigram piece scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.llm.textscan import Slice, slices

#: Added to every word's count in the base score, and to every piece's count in the model.
ALPHA = 0.1
#: Every tenth document by checksum is held out.
FOLDS = 10
#: Stands in front of every word in the lattice, as in the vocabulary.
MARK = "▁"
#: The most frequent words, at most so many (24 bytes each), are scored where the documents are read.
HEAD_WORDS = 100_000
#: A task's words are handed on once it has so many different ones.
FLUSH_WORDS = 1_000_000
#: Words of more characters are scored one by one.
WIDE = 48
#: An unknown character counts as a piece of its own with the least piece probability over this many characters.
UNKNOWN_SPREAD = 1 << 16
END = ""


def _held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _distinct(s: Slice, train: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Hashes, words, counts in training rows and in all rows, of the distinct lower-cased words of a slice."""
    hashes = s.word_hashes(lower=True)
    values, first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(s)), np.diff(s.bounds))
    trained = np.bincount(inverse, weights=train[rows], minlength=len(values)).astype(np.int64)
    data = _LOWER[s.data]
    offsets = np.append(s.starts, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(s.starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).take(pa.array(first))
    return values, pc.ascii_trim_whitespace(words), trained, counts.astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, summed as far as one task can; from (train, text)."""
    held: list[tuple] = []
    size = 0

    def merged() -> pa.RecordBatch:
        hashes = np.concatenate([h[0] for h in held])
        values, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        words = pa.concat_arrays([h[1] for h in held]).take(pa.array(first)).cast(pa.string())
        sums = [np.bincount(inverse, weights=np.concatenate([h[c] for h in held]), minlength=len(values)).astype(np.int64) for c in (2, 3)]
        return pa.RecordBatch.from_arrays([words, *map(pa.array, sums)], names=["word", "c", "c_all"])

    for batch in batches:
        train = np.array(batch.column(0).fill_null(False)).astype(float)
        for s in slices(batch.column(1)):
            held.append(_distinct(s, train[s.first : s.first + len(s)]))
            size += len(held[-1][0])
            if size > FLUSH_WORDS:
                yield merged()
                held, size = [], 0
    if held:
        yield merged()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, c_all): each lower-cased word with its count in training documents and in all, written once.

    The empty word stands for the ends of texts.
    """
    words = docs.select((~_held_out(F.col("doc_id"))).alias("train"), "text").mapInArrow(_counted, "word string, c long, c_all long")
    ends = docs.select(F.lit(END).alias("word"), (~_held_out(F.col("doc_id"))).cast("long").alias("c"), F.lit(1).cast("long").alias("c_all"))
    return freeze(words.unionByName(ends).groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all")), "words")


def load_pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces by id; control and byte pieces are empty strings, which match nothing."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i) for i in range(n)]


def _segmented(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often the vocabulary's own segmentation of the training words uses each piece: (piece, n), summed by task."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sums = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            counts = np.array(batch.column(1))
            words = batch.column(0).to_pylist()
            for i in range(0, len(words), 20_000):
                ids = sp.encode(words[i : i + 20_000], num_threads=1)
                flat = np.fromiter((x for e in ids for x in e), np.int64)
                weights = np.repeat(counts[i : i + 20_000], [len(e) for e in ids])
                sums += np.bincount(flat, weights=weights, minlength=len(sums)).astype(np.int64)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["piece", "n"])

    return run


def _text_hashes(chars: np.ndarray, longest: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, length, hashes) of all stretches of up to longest characters of rows of code points."""
    width = chars.shape[1]
    for start in range(width):
        h = np.zeros(len(chars), np.uint64)
        for length in range(1, min(longest, width - start) + 1):
            h = (h ^ chars[:, start + length - 1]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            yield start, length, h


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    chars = np.zeros((len(words), max(1, lengths.max(initial=1))), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chars[rows, at] = flat + np.uint64(1)
    return chars, lengths


class Lattice:
    """Marginal log probabilities of words: the sum over all segmentations into pieces of the product of their probabilities."""

    def __init__(self, pieces: list[str], log_p: np.ndarray, unknown: float) -> None:
        usable = [i for i, p in enumerate(pieces) if p]
        texts = [pieces[i] for i in usable]
        hashes = np.zeros(len(texts), np.uint64)
        chars, lengths = _code_points(texts)
        self.longest = max(map(len, texts), default=1)
        for start, length, h in _text_hashes(chars, self.longest):
            if start:
                break
            hashes[lengths == length] = h[lengths == length]
        order = np.argsort(hashes)
        self.hashes, self.log_p, self.unknown = hashes[order], log_p[usable][order], unknown

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.log_p[at], -np.inf)

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability, by the forward recursion in log space."""
        out = np.zeros(len(words))
        order = np.argsort([len(w) for w in words], kind="stable")
        for i in range(0, len(words), 20_000):
            at = order[i : i + 20_000]
            some = [MARK + words[j] for j in at]
            narrow = [k for k, w in enumerate(some) if len(w) <= WIDE]
            if narrow:
                out[at[narrow]] = self._forward([some[k] for k in narrow])
            for k, w in enumerate(some):
                if len(w) > WIDE:
                    out[at[k]] = self._long(w)
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        chars, lengths = _code_points(words)
        n, width = chars.shape
        forward = np.full((width + 1, n), -np.inf)
        forward[0] = 0.0
        for start, length, h in _text_hashes(chars, self.longest):
            fits = start + length <= lengths
            p = np.where(fits, self._look_up(h), -np.inf)
            if length == 1:
                p = np.where(np.isneginf(p) & fits, self.unknown, p)
            step = forward[start] + p
            forward[start + length] = np.logaddexp(forward[start + length], step)
        return forward[lengths, np.arange(n)]

    def _long(self, word: str) -> float:
        """One word of any length, in steps over its characters with memory for as many as the longest piece has."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        n = len(chars)
        forward = np.full(n + 1, -np.inf)
        forward[0] = 0.0
        scores = np.full((self.longest, n), -np.inf)
        h = np.zeros(n, np.uint64)
        for length in range(1, min(self.longest, n) + 1):
            m = n - length + 1
            h = (h[:m] ^ chars[length - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            scores[length - 1, :m] = self._look_up(h)
        scores[0] = np.where(np.isneginf(scores[0]), self.unknown, scores[0])
        for end in range(1, n + 1):
            k = min(self.longest, end)
            terms = forward[end - k : end][::-1] + scores[np.arange(k), end - 1 - np.arange(k)]
            top = terms.max()
            forward[end] = top + math.log(np.exp(terms - top).sum())
        return float(forward[n])


def fit(words: DataFrame, path: str) -> tuple[Lattice, float, dict[str, int]]:
    """The lattice, the log probability of an end, and the totals N and V, from the table of word counts.

    Each piece of the existing vocabulary has its smoothed share of the segmented training words as probability,
    with one share for ends. What reaches the driver has at most one row per piece of the vocabulary.
    """
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    pieces = load_pieces(path)
    used = words.where(f"c > 0 and word <> '{END}'").select("word", "c").mapInArrow(_segmented(path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.array([ALPHA if p else 0.0 for p in pieces])
    for r in used:
        if pieces[r["piece"]]:
            counts[r["piece"]] += r["n"]
    whole = counts.sum() + totals["ends"] + 2 * ALPHA
    log_p = np.log(np.maximum(counts, 1e-300) / whole)
    return Lattice(pieces, log_p, math.log(ALPHA / whole / UNKNOWN_SPREAD)), math.log((totals["ends"] + ALPHA) / whole), {"n": totals["n"], "v": totals["v"]}


def _scored(lattice: Lattice, end: float, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, c, c_all, base, score): log10 of both models for each word."""
        for batch in batches:
            words = batch.column(0).to_pylist()
            c = np.array(batch.column(1))
            logs = np.where([w == END for w in words], end, lattice.score(words)) / math.log(10)
            base = np.log10((c + ALPHA) / (n + ALPHA * (v + 1)))
            hashes = np.concatenate([s.span_hashes(s.offsets[:-1], s.offsets[1:]) for s in slices(batch.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(1), batch.column(2), pa.array(base), pa.array(logs)], names=["h", "c", "c_all", "base", "score"])

    return run


def _looked_up(head) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (row, is_word, h, n, ...): for each document what its frequent words add, with its row number as h, and one row per other word with its count."""
        hashes, known, base, score = head.value
        for batch in batches:
            rows, ids = np.array(batch.column(0)), batch.column(1)
            for s in slices(batch.column(2)):
                words, k = s.word_hashes(lower=True), len(s)
                at = np.minimum(np.searchsorted(hashes, words), max(len(hashes) - 1, 0))
                found = hashes[at] == words if len(hashes) else np.zeros(len(words), bool)
                doc = np.repeat(np.arange(k), np.diff(s.bounds))
                add = lambda values: np.bincount(doc[found], weights=values[at[found]], minlength=k) if len(hashes) else np.zeros(k)
                n = np.diff(s.bounds).astype(np.int64)
                sums = [add(known).astype(np.int64), add(base), add(score)]
                rest_doc, rest = doc[~found], words[~found]
                order = np.lexsort((rest, rest_doc))
                rest_doc, rest = rest_doc[order], rest[order]
                new = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (rest_doc[1:] != rest_doc[:-1])])) if len(rest) else np.zeros(0, np.int64)
                many = np.diff(np.append(new, len(rest))).astype(np.int64)
                m = len(new)
                own = rows[s.first : s.first + k]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(own), pa.array(own[rest_doc[new]])]), pa.array(np.repeat([False, True], [k, m])), pa.concat_arrays([pa.array(own), pa.array(rest[new].view(np.int64))]), pa.array(np.concatenate([n, many])),
                        pa.concat_arrays([ids.slice(s.first, k), pa.nulls(m, pa.int64())]), *[pa.array(np.concatenate([x, np.zeros(m, x.dtype)])) for x in sums],
                    ],
                    names=["row", "is_word", "h", "n", "doc_id", "known", "base", "score"],
                )

    return run


def score_documents(docs: DataFrame, path: str, head_words: int = HEAD_WORDS) -> DataFrame:
    """Every whole text's base and model log10 probability, learned from the documents that are not held out.

    Words are counted over the whole corpus, each distinct word is scored once by its lattice, and documents get
    their words' scores back: the frequent words' from a broadcast of at most head_words rows (the count threshold
    is chosen so that no more reach it), all others by a join on (document, word) counts. A null text is empty: it
    has its end only. A null doc_id counts as empty text for the checksum, so it is held out. Repeated rows are told
    apart by their number in the scan.
    """
    words = word_counts(docs)
    lattice, end, totals = fit(words, path)
    scored = freeze(words.mapInArrow(_scored(lattice, end, totals["n"], totals["v"]), "h long, c long, c_all long, base double, score double"), "word_scores")
    sizes = {r["k"]: r["count"] for r in scored.groupBy(F.floor(F.log2("c_all")).alias("k")).count().collect()}
    level, taken = max(sizes, default=0) + 1, 0
    while level > 0 and taken + sizes.get(level - 1, 0) <= head_words:
        level, taken = level - 1, taken + sizes.get(level - 1, 0)
    is_head = F.floor(F.log2("c_all")) >= level
    head = scored.where(is_head).select("h", (F.col("c") > 0).cast("long").alias("known"), "base", "score").toArrow()
    columns = [np.array(head.column(i).combine_chunks()) for i in range(4)]
    order = np.argsort(columns[0].view(np.uint64))
    spread = docs.sparkSession.sparkContext.broadcast((columns[0].view(np.uint64)[order], *[c[order] for c in columns[1:]]))
    seen = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), "text").mapInArrow(_looked_up(spread), "row long, is_word boolean, h long, n long, doc_id long, known long, base double, score double")
    tail = scored.where(~is_head).select(F.col("h").alias("_h"), "c", F.col("base").alias("_base"), F.col("score").alias("_score"))
    joined = seen.join(tail, F.col("is_word") & (F.col("h") == F.col("_h")), "left")  # documents' rows match nothing and are spread by their numbers
    per_doc = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum(F.when(~F.col("is_word"), F.col("n"))).alias("_words"),
        F.sum(F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"),
        F.sum(F.col("base") + F.coalesce(F.col("n") * F.col("_base"), F.lit(0.0))).alias("_base"), F.sum(F.col("score") + F.coalesce(F.col("n") * F.col("_score"), F.lit(0.0))).alias("_score"),
    )
    ends = words.where(F.col("word") == END).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]
    base_end = math.log10((ends + ALPHA) / (totals["n"] + ALPHA * (totals["v"] + 1)))
    return per_doc.select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), (F.col("_words") + 1).alias("n_tokens"), (F.col("_known") + int(ends > 0)).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"), (F.col("_base") + base_end).alias("base_score"), (F.col("_score") + end / math.log(10)).alias("score"),
    )
