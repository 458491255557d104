"""Cross-tokenizer alignment: the token ends of two tokenizers over one text, matched by diagonal run skipping."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.checkpoints import freeze
from cueloom.llm.textscan import Slice, slices

#: Chunks of text whose ids a worker remembers (about 60 bytes each); longer ones than CHUNK_BYTES are tokenised wherever they stand.
REMEMBERED = 1_000_000
CHUNK_BYTES = 64
#: New chunks are tokenised so many at a time, as one text.
TOGETHER = 2000
#: A text is aligned in lanes of so many chunks, all lanes of a slice in step; chunks end where tokens of both kinds do.
LANE_CHUNKS = 32
#: The most frequent id pairs, at most so many (17 bytes each), are looked up where documents are read.
HEAD_PAIRS = 1 << 20
#: Room for pair codes below a row's number in one 64-bit key.
PAIR_BITS = 40


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable ones stand for themselves, the others, in order, for 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(plain)))}


def solid_before(s: Slice) -> np.ndarray:
    """For each place in a slice and its end, whether the character before is surely no white space of any kind.

    The last byte of some two- and three-byte characters may end Unicode white space, so all of their rows count as unsure.
    """
    d, n = s.data, len(s.data)
    back = [np.concatenate([np.zeros(k, np.uint8), d])[: n + 1] for k in (1, 2, 3)]
    plain = (back[0] > 0x20) & (back[0] < 0x7F)
    return plain | ((back[0] >= 0x80) & (back[1] != 0xC2) & ~np.isin(back[2], (0xE1, 0xE2, 0xE3)))


def chunks(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, whether another chunk may follow directly) of the stretches that both tokenizers cut at, whatever stands around.

    A stretch begins with a space after a character that is no white space. Tokens of A hold spaces in front only, and
    no entry of B has one after anything else, so no token crosses the cut.
    """
    solid = solid_before(s)
    begins = (s.data == 0x20) & solid[:-1]
    begins[s.offsets[:-1][s.offsets[:-1] < len(s.data)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(s.data))[: len(starts)]
    return starts, ends, solid[ends]


@dataclass
class Vocabulary:
    """What a tokenizer makes of a text that begins with a space, and the bytes of each id."""

    encode: object
    pieces: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)


def load(path_a: str, path_b: str) -> tuple[Vocabulary, Vocabulary]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    byte_of, entries = _byte_of(), a.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        pieces[i] = bytes(byte_of.get(c, 63) for c in token)
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    own = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if any(" " in p.replace("▁", " ").lstrip(" ") for p in own):
        raise ValueError(f"{path_b} has entries with a space after another character, so texts cannot be cut at spaces")
    space = b.piece_to_id("▁")
    pieces_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(own)]
    return (
        Vocabulary(lambda text: a.encode(text, add_special_tokens=False).ids, pieces),
        Vocabulary(lambda text: [space] if text == " " else b.encode(text[1:], num_threads=1), pieces_b),
    )


class TokenPairs:
    """Ids of both tokenizers for slices of texts, from chunks of which the ones seen lately are remembered in flat arrays."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED) -> None:
        self.vocabularies, self.remembered = load(path_a, path_b), remembered
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.fits = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.first, self.count, self.ids = ([np.zeros(0, t) for _ in range(2)] for t in (np.int64, np.int32, np.int32))

    def _tokenised(self, texts: list[bytes], joinable: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(whether both give back the bytes, counts of ids by tokenizer, ids by tokenizer) of chunks."""
        fits, counts, ids = np.ones(len(texts), bool), [np.zeros(len(texts), np.int64) for _ in range(2)], [[], []]
        together = np.flatnonzero(joinable)
        blocks = [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)] + [np.array([n]) for n in np.flatnonzero(~joinable)]
        order: list[np.ndarray] = []
        while blocks:
            block = blocks.pop()
            own = [texts[n] for n in block]
            whole = b"".join(own)
            cuts = np.cumsum([len(x) for x in own])
            found = []
            for v in self.vocabularies:
                e = np.array(v.encode(whole.decode("utf-8", "replace")), np.int32)
                ends = np.cumsum(v.sizes[e])
                at = np.searchsorted(ends, cuts)
                if b"".join(map(v.pieces.__getitem__, e.tolist())) == whole and at[-1] < len(ends) and (ends[at] == cuts).all():
                    found.append((e, np.diff(at + 1, prepend=0)))
            if len(found) < 2 and len(block) > 1:
                blocks += [np.array([n]) for n in block]
                continue
            order.append(block)
            if len(found) < 2:
                fits[block] = False
                continue
            for k in range(2):
                ids[k].append(found[k][0])
                counts[k][block] = found[k][1]
        place = np.concatenate([np.zeros(0, np.int64), *order])
        out = []
        for k in range(2):
            flat, n = np.concatenate([np.zeros(0, np.int32), *ids[k]]), counts[k][place]
            first = np.zeros(len(texts), np.int64)
            first[place] = np.cumsum(n) - n
            out.append(flat[_ranges(first, counts[k])])
        return fits, counts, out

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def of(self, s: Slice) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids by tokenizer, ids before each chunk and in all by tokenizer, the number of each row's first chunk and of all chunks).

        Rows of which some chunk's bytes do not come back from both tokenizers have no ids.
        """
        data = s.data.tobytes()
        starts, ends, joinable = chunks(s)
        rows = np.searchsorted(starts, s.offsets)
        alone = ends - starts > CHUNK_BYTES

        def tokenised(which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
            return self._tokenised([data[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)], joinable[which])

        hashes, place, number = np.unique(s.span_hashes(starts[~alone], ends[~alone]), return_index=True, return_inverse=True)
        at, known = self._find(hashes)
        if not known.all():
            if len(self.hashes) + len(hashes) > self.remembered:
                self._forget()
                known[:] = False
            fits, counts, ids = tokenised(np.flatnonzero(~alone)[place[~known]])
            at = np.searchsorted(self.hashes, hashes[~known])
            self.hashes, self.fits = np.insert(self.hashes, at, hashes[~known]), np.insert(self.fits, at, fits)
            for k in range(2):
                self.first[k] = np.insert(self.first[k], at, len(self.ids[k]) + np.cumsum(counts[k]) - counts[k])
                self.count[k] = np.insert(self.count[k], at, counts[k])
                self.ids[k] = np.concatenate([self.ids[k], ids[k]])
            at, _ = self._find(hashes)
        fits, counts, ids = tokenised(np.flatnonzero(alone))
        whole = np.ones(len(starts), bool)
        whole[~alone], whole[alone] = self.fits[at][number], fits
        bad = np.zeros(len(s) + 1, bool)
        bad[np.searchsorted(rows, np.flatnonzero(~whole), "right") - 1] = True
        dropped = bad[np.searchsorted(rows, np.arange(len(starts)), "right") - 1]
        found, before = [], []
        for k in range(2):
            first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
            first[~alone], count[~alone] = self.first[k][at][number], self.count[k][at][number]
            first[alone], count[alone] = len(self.ids[k]) + np.cumsum(counts[k]) - counts[k], counts[k]
            count[dropped] = 0
            before.append(np.concatenate([[0], np.cumsum(count)]))
            found.append(np.concatenate([self.ids[k], ids[k]])[_ranges(first, count)])
        return found, before, rows


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), then those of first[1], and so on."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - count), count)


def align(ends_a: np.ndarray, ends_b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which tokens of A close a group, which of B, the A token of each link, its B token), by diagonal run skipping.

    begin and end have a row for A and one for B: the stretches of the two end arrays that lanes align, each
    from one common end to another. A lane stands at tokens i and j, hence at the shift j - i. It compares the next ends
    of both arrays at this shift, one, two, four and so on as long as all agree, so a stretch of tokens that match one to
    one takes few steps. At the first that differ, it walks to the next common end, always on the side that ends first: all pairs
    it stands at are links. The shift there is the lane's new one. All lanes take each step together.
    """
    closes_a, closes_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    i, j = begin[0].copy(), begin[1].copy()
    width = np.ones(len(i), np.int64)
    live = np.flatnonzero(i < end[0])
    while len(live):
        left = np.minimum(end[0, live] - i[live], end[1, live] - j[live])
        probed = np.minimum(width[live], left)
        first = np.cumsum(probed) - probed
        step = np.arange(int(probed.sum())) - np.repeat(first, probed)
        at = np.repeat(i[live], probed) + step
        shift = np.repeat(j[live] - i[live], probed)
        run = np.minimum.reduceat(np.where(ends_a[at] == ends_b[at + shift], np.repeat(probed, probed), step), first)
        equal = step < np.repeat(run, probed)
        at, shift = at[equal], shift[equal]
        closes_a[at] = closes_b[at + shift] = True
        links_a.append(at)
        links_b.append(at + shift)
        i[live] += run
        j[live] += run
        width[live] = np.where(run == probed, 2 * probed, 1)
        open_ = live[run < probed]
        while len(open_):
            links_a.append(i[open_])
            links_b.append(j[open_])
            a, b = ends_a[i[open_]], ends_b[j[open_]]
            closes_a[i[open_[a == b]]] = closes_b[j[open_[a == b]]] = True
            i[open_] += a <= b
            j[open_] += b <= a
            open_ = open_[a != b]
        live = live[i[live] < end[0, live]]
    return closes_a, closes_b, np.concatenate(links_a), np.concatenate(links_b)


class Written:
    """Groups in decimal: A ids, a bar, B ids, a semicolon."""

    def __init__(self, largest: int) -> None:
        self.largest = largest
        shown = [str(i).encode() + mark for mark in (b",", b"|", b";") for i in range(largest + 1)]
        self.sizes = np.array([len(x) for x in shown])
        self.packed = np.array(shown, f"S{8 if self.sizes.max() <= 8 else 16}").view(np.uint64).reshape(len(shown), -1)

    def groups(self, ids: list[np.ndarray], closes: list[np.ndarray]) -> tuple[bytes, np.ndarray]:
        """(bytes of all groups, number of bytes before each id and in all), ids in the order written."""
        ends = [np.flatnonzero(c) + 1 for c in closes]
        group = [np.cumsum(c) - c for c in closes]
        codes = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
        codes[np.arange(len(ids[0])) + np.concatenate([[0], ends[1]])[group[0]]] = ids[0] + (self.largest + 1) * closes[0]
        codes[np.arange(len(ids[1])) + ends[0][group[1]]] = ids[1] + (self.largest + 1) * 2 * closes[1]
        flat = np.stack([column[codes] for column in self.packed.T], axis=1).view(np.uint8).ravel()
        return flat[flat != 0].tobytes(), np.concatenate([[0], np.cumsum(self.sizes[codes])])


_loaded: dict[tuple, tuple[TokenPairs, Written]] = {}


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) from (row, doc_id, space and text)."""
        if (path_a, path_b) not in _loaded:
            tokens = TokenPairs(path_a, path_b)
            _loaded[path_a, path_b] = tokens, Written(max(len(v.pieces) for v in tokens.vocabularies))
        tokens, written = _loaded[path_a, path_b]
        a, b = tokens.vocabularies
        for batch in batches:
            for s in slices(batch.column(2)):
                ids, before, rows = tokens.of(s)
                ends = [np.cumsum(v.sizes[i]) for v, i in zip((a, b), ids, strict=True)]
                n = len(s)
                number = np.arange(len(before[0]) - 1) - np.repeat(rows[:-1], np.diff(rows))
                lanes = np.append(np.flatnonzero(number % LANE_CHUNKS == 0), len(number))
                bounds = np.stack([x[lanes] for x in before])
                closes_a, closes_b, link_a, link_b = align(*ends, bounds[:, :-1], bounds[:, 1:])
                upto = [x[rows] for x in before]
                doc = np.searchsorted(upto[0], link_a, "right") - 1
                keys, times = np.unique((doc << PAIR_BITS) | (ids[0][link_a].astype(np.int64) * len(b.pieces) + ids[1][link_b]), return_counts=True)
                pairs = np.searchsorted(keys >> PAIR_BITS, np.arange(n + 1)).astype(np.int32)
                raw, place = written.groups(ids, [closes_a, closes_b])
                cut = place[upto[0] + upto[1]]
                shas = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                closed = np.concatenate([[0], np.cumsum(closes_a)])[upto[0]]
                counts = [np.diff(upto[0]), np.diff(upto[1]), np.diff(closed), np.bincount(doc, minlength=n)[:n]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(s.first, n), batch.column(1).slice(s.first, n), *[pa.array(c.astype(np.int64)) for c in counts], pa.array(shas, pa.string()),
                        pa.ListArray.from_arrays(pa.array(pairs), pa.array(keys & ((1 << PAIR_BITS) - 1))), pa.ListArray.from_arrays(pa.array(pairs), pa.array(times.astype(np.int32))),
                    ],
                    names=["_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return run


def _summed(head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with the sums over their frequent pairs, and lists of the others."""
        codes, counts, best = head.value
        for batch in batches:
            names = batch.schema.names
            pairs, times = batch.column(names.index("pairs")), batch.column(names.index("times"))
            bounds = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            code, many = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            shown = [np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)]
            shown[0][known], shown[1][known] = (many * best[at])[known] if len(codes) else 0, (many * counts[at])[known] if len(codes) else 0
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[bounds]) for x in shown]
            rest = pa.array(np.concatenate([[0], np.cumsum(~known)])[bounds].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c, n in enumerate(names) if n not in ("pairs", "times")], *map(pa.array, sums), pa.ListArray.from_arrays(rest, pa.array(code[~known])), pa.ListArray.from_arrays(rest, pa.array(many[~known].astype(np.int32)))],
                names=[*[n for n in names if n not in ("pairs", "times")], "n_best", "count_sum", "pairs", "times"],
            )

    return run


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each row's tokens, groups and links of both tokenizers, with its id pairs and how often each is linked, written once.

    A pair's code is the A id times the number of B ids plus the B id. Null and empty texts, and texts whose
    bytes do not come back from both tokenizers, have no tokens. Texts are tokenised whole and cut at no length.
    """
    text = F.when(F.col("text") != "", F.concat(F.lit(" "), F.col("text")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", text.alias("text"))
    schema = f"_row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return freeze(rows.mapInArrow(_aligned(path_a, path_b), schema), "aligned")


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each id pair, and whether no pair with the same B id has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    pairs = freeze(pairs, "pairs")
    most = pairs.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))  # a row for each entry of the vocabulary at most
    return freeze(pairs.join(F.broadcast(most), F.col("pair") % n_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def align_documents(docs: DataFrame, path_a: str, path_b: str, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """Per row: n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id, ties included), count_sum and groups_sha256.

    Texts are tokenised and aligned once; what is kept is each row's distinct pairs. Their corpus-wide counts come
    back from a broadcast of the most frequent pairs (at most head_pairs rows; the threshold is chosen so that no more
    reach it) and, for pairs too rare to be among these, from a join: each of them stands in few links, so no key is hot.
    Repeated rows are rows of their own and count anew; an empty table gives an empty one; other columns are left alone.
    """
    import sentencepiece

    aligned = aligned_documents(docs, path_a, path_b)
    counts = pair_counts(aligned, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size())
    sizes = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}
    level, taken = max(sizes, default=0) + 1, 0
    while level > 0 and taken + sizes.get(level - 1, 0) <= head_pairs:
        level, taken = level - 1, taken + sizes.get(level - 1, 0)
    is_head = F.floor(F.log2("n")) >= level
    head = counts.where(is_head).toArrow()
    columns = [head.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in range(3)]
    order = np.argsort(columns[0])
    spread = docs.sparkSession.sparkContext.broadcast(tuple(c[order] for c in columns))
    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    schema = ", ".join(f"{n} {t}" for n, t in aligned.dtypes if n in names) + ", n_best long, count_sum long, pairs array<long>, times array<int>"
    summed = freeze(aligned.mapInArrow(_summed(spread), schema), "summed")
    rare = summed.where(F.size("pairs") > 0).select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), "p.times")
    rest = rare.join(counts.where(~is_head).hint("merge"), "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    more = lambda name, own: (F.col(name) + F.coalesce(F.col(own), F.lit(0))).alias(name)
    return summed.join(rest, "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "_best"), more("count_sum", "_sum"), "groups_sha256")
