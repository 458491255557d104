"""Cross-tokenizer alignment against a plain version, token by token."""

import hashlib
from collections import Counter
from random import Random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cueloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "plain words, of   several kinds.\n\nNew\tline ", "<|endoftext|> and <s> </s> <0x41>", "has ▁ inside", "▁", "naïve café – „quoted“ 日本語 の 😀😀 text", "a  b  c　 d \x1c e\x85 f", "x" * 300 + " " + "antidisestablishmentarianism" * 40,
    "don't won't they're 12345678901 3.14159", " lead", "trail   ", "\n", "\x00 nul", "plain words, of   several kinds.\n\nNew\tline ", "é", "  two  spaces  in  rows  ", "ﬁ ½ ①", "the the the the thanedble ernthing",
]


@pytest.fixture(scope="module")
def tokenizers():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, tokenizers):
    t, sp = tokenizers
    shown = {}
    n = 0
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        shown[chr(b if printable else 256 + n)] = b
        n += not printable
    if not text:
        return [], []
    a = t.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(shown[c] for c in p)) for i, p in zip(a.ids, a.tokens)]
    right = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def spans(found):
    at, out = 0, []
    for i, raw in found:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts, tokenizers):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) of each text."""
    rows, counts = [], Counter()
    for text in texts:
        left, right = (spans(x) for x in tokens(text, tokenizers))
        links = [(a, b) for a, s, e in left for b, s2, e2 in right if s < e2 and s2 < e]
        counts.update(links)
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, start = [], 0
        for cut in cuts:
            inside = [",".join(str(i) for i, s, e in side if start < e <= cut) for side in (left, right)]
            groups.append("|".join(inside))
            start = cut
        rows.append((len(left), len(right), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(a, b, g, len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), sha) for a, b, g, k, sha in rows]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [alignment.HEAD_PAIRS, 30, 0])
def test_documents_equal_plain_alignment(spark, tokenizers, head):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs int, _row string").repartition(3)
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(docs, A, B, head).collect()}
    for i, want in enumerate(brute(TEXTS, tokenizers)):
        assert rows[i] == want, TEXTS[i]
    assert rows[0] == (0, 0, 0, 0, 0, 0, "") == rows[6] and rows[5][0]


def test_given_documents_equal_plain_alignment(spark, tokenizers):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500")
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align_documents(some, A, B).collect()}
    assert rows == dict(zip(texts, brute(list(texts.values()), tokenizers), strict=True))


def test_lanes_find_the_common_ends_of_any_arrays():
    rng = Random(5)
    for _ in range(200):
        size = rng.randint(1, 60)
        common = sorted({0, size, *(rng.randrange(1, size) for _ in range(rng.randint(0, 2)) if size > 1)})
        ends = [np.array(sorted({*common[1:], *(rng.randrange(1, size + 1) for _ in range(rng.randint(0, size)))})) for _ in range(2)]
        if rng.random() < 0.5:
            ends[1] = ends[0].copy()
        bounds = np.array([np.searchsorted(e, common, "right") for e in ends])
        closes_a, closes_b, link_a, link_b = alignment.align(*ends, bounds[:, :-1], bounds[:, 1:])
        both = set(ends[0]) & set(ends[1])
        assert set(ends[0][closes_a]) == both == set(ends[1][closes_b])
        begins = [np.concatenate([[0], e[:-1]]) for e in ends]
        want = {(x, y) for x in range(len(ends[0])) for y in range(len(ends[1])) if begins[0][x] < ends[1][y] and begins[1][y] < ends[0][x]}
        assert set(zip(link_a.tolist(), link_b.tolist())) == want and len(link_a) == len(want)


def test_little_memory_gives_the_same_ids(tokenizers):
    import pyarrow as pa

    from cueloom.llm.textscan import slices

    small, large = alignment.TokenPairs(A, B, remembered=3), alignment.TokenPairs(A, B)
    column = pa.array([" " + t for t in TEXTS if t])
    for limit in (20, 200, 1 << 20):
        for s in slices(column, limit):
            for one, other in zip(small.of(s), large.of(s), strict=True):
                assert all(np.array_equal(x, y) for x, y in zip(one, other, strict=True))


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
